"""Rules over email addresses, as SQL expressions."""

from __future__ import annotations

from . import rules as R
from .dialect import Dialect
from .keys import host, letters, local, vowels
from .names import any_of


def has_at(email: str) -> str:
    return f"coalesce(contains({email}, '@'), false)"


def found(d: Dialect, text: str) -> str:
    """Addresses of a text in order: known top-level domains; two to four letters only if there is none of those. Junk is dropped."""
    # a letter or dot after the domain disqualifies it: the text is marked after each candidate, so no look-ahead is needed
    pad = lambda x: f"{d.rep(x, '[^a-zA-Z0-9._%+@-]+', '  ')} || ' '"
    ends = "(" + R.KNOWN_TLDS + "))[^a-z.]"
    junk = f"NOT {d.holds('lower(e)', R.EMAIL_JUNK)}"
    if d.duck:
        known = d.extract_all(pad(text), "(?i)([a-z0-9._%+-]+@[a-z0-9.-]+\\." + ends, 1)
        loose = d.extract_all(pad(text), "([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,4})[^a-zA-Z]", 1)
        return d.filter(f"CASE WHEN {d.size(known)} > 0 THEN {known} ELSE {loose} END", "e", junk)
    # whether an address fits does not depend on where in a run of its characters it begins: each run is tried once, where it
    # begins or the last match ended, so the search stays linear on long runs; what both searches read is worked out once
    once = "(?:\\G|(?<![a-zA-Z0-9._%+-]))"
    known = d.extract_all("padded_text", f"(?i){once}([a-z0-9._%+-]++@[a-z0-9.-]+\\.{ends}", 1)
    loose = d.extract_all("padded_text", f"{once}([a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,4}})[^a-zA-Z]", 1)
    best = d.let(known, "known_mails", f"CASE WHEN {d.size('known_mails')} > 0 THEN known_mails ELSE {loose} END")
    return f"CASE WHEN NOT contains({text}, '@') THEN {d.text_array()} ELSE {d.filter(d.let(pad(text), 'padded_text', best), 'e', junk)} END"


def _bare(d: Dialect, email: str) -> str:
    """The first address that begins with a letter, lower case, brackets and quotes dropped; empty if there is none."""
    bare = d.rep(email, "[<>\\x22\\x27\\[\\](){}]")
    return f"lower({d.extract(bare, '[a-zA-Z][a-zA-Z0-9._%+-]*@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,7}\\b')})"


def cleaned(d: Dialect, email: str, compat: bool = False) -> str:
    """The address inside a raw value; null if there is none or it is junk. `compat` cuts its domain at the leftmost known ending, as decision D2 has it."""
    got = _bare(d, d.rep(email, "<[^>]+>"))
    if compat:
        cut = d.extract(got, "^([^@]*@.*?[.](?:" + R.COMPAT_TLDS + "))", 1)
        got = f"coalesce(nullif({cut}, ''), {got})"
    return f"CASE WHEN {got} = '' OR {d.holds(got, R.CLEAN_JUNK)} THEN NULL ELSE {got} END"


def cleaned_strictly(d: Dialect, email: str) -> str:
    """The address as the rendering job cleans it: limits of length, and junk by local part, host, known bad beginnings and file endings."""
    got = _bare(d, f"trim({email})")
    user, place = f"split_part({got}, '@', 1)", f"split_part({got}, '@', 2)"
    junk = f"{d.word(user, R.JUNK_LOCALS)} OR {d.holds(got, R.BAD_EMAILS)} OR {d.holds(place, R.JUNK_HOSTS)} OR {d.match(got, '[.](png|jpg|gif|svg|css|js)$')}"
    return f"CASE WHEN {got} = '' OR length({user}) > 64 OR length({got}) > 254 OR {junk} THEN NULL ELSE {got} END"


def generic(d: Dialect, email: str) -> str:
    """Exact local part of a shared mailbox."""
    return f"({has_at(email)} AND {d.word(local(email), R.GENERIC_LOCALS)})"


def generic_prefix(d: Dialect, email: str) -> str:
    return f"coalesce({d.match(local(email), '^(' + any_of(R.GENERIC_PREFIXES) + ')')}, false)"


def free_mail(d: Dialect, email: str) -> str:
    return f"coalesce({d.word(f'''lower(split_part({email}, '@', 2))''', R.FREE_PROVIDERS)}, false)"


def gibberish(d: Dialect, email: str) -> str:
    parts = d.split(local(email), "[._-]")
    low = letters(d, "w")
    bad = f"""(length({low}) >= 3 AND {vowels(d, low)} < 0.2 * length({low})) OR {d.word(f'left({low}, 2)', R.BIGRAMS)} OR {d.word(f'left({low}, 3)', R.TRIGRAMS)}"""
    return f"({has_at(email)} AND NOT {generic(d, email)} AND {d.some(parts, 'w', bad)})"


def matches_contact(d: Dialect, email: str, name: str) -> str:
    """False only where a person-like local part shows no part of the contact's name."""
    own = local(email)
    segments = d.filter(d.split(own, "[._-]"), "w", f"{d.match('w', '^[a-z]{2,}$')} AND NOT {d.word('w', sorted({*R.GENERIC_LOCALS, *R.ROLE_LOCALS, *R.BUSINESS_WORDS}))}")
    parts = d.filter(d.map(d.filter(d.split(f"trim({name})", "\\s+"), "w", "length(w) >= 2"), "w", letters(d, "w")), "w", f"w <> '' AND NOT {d.word('w', R.TITLES)}")
    hit = d.some(parts, "w", f"length(w) >= 3 AND contains({own}, w)")
    initial = f"({d.size(parts)} >= 2 AND left({d.at(parts, '1')}, 1) = left({own}, 1) AND contains({own}, {d.at(parts, d.size(parts))}))"
    return f"coalesce(NOT {has_at(email)} OR coalesce({name}, '') = '' OR {d.word(f'''lower(split_part({email}, '@', 2))''', R.FREE_MAIL)} OR {d.size(segments)} < 2 OR {d.size(parts)} = 0 OR {hit} OR {initial}, true)"


#: What a guessed address looks like.
GUESS = "^[a-z][a-z0-9._%+-]*@[a-z0-9.-]+\\.[a-z]{2,7}$"


def guesses(d: Dialect, name: str, site: str) -> str:
    """Eight address patterns of a contact, in order; none without two words and a dotted domain."""
    w = d.split(f"lower(trim({name}))", "\\s+")
    parts = d.tuple(n=d.size("x"), a=letters(d, d.at("x", "1")), b=letters(d, d.at("x", d.size("x"))))
    # words, then their letters, are bound once as lambda variables
    pair = d.map(d.wrap(w), "x", parts)
    i, j = "left(y.a, 1)", "left(y.b, 1)"
    forms = ["y.a || '.' || y.b", f"{i} || '.' || y.b", "y.a", "y.b", "y.a || '_' || y.b", "y.a || y.b", f"y.a || {j}", f"{i} || {j}"]
    made = ("[" if d.duck else "array(") + ", ".join(f"{f} || '@' || {site}" for f in forms) + ("]" if d.duck else ")")
    good = d.filter(made, "g", d.match("g", GUESS))
    return d.at(d.map(pair, "y", f"CASE WHEN y.n >= 2 AND y.a <> '' AND y.b <> '' AND contains({site}, '.') THEN {good} ELSE {d.text_array()} END"), "1")


def domain_match(d: Dialect, email: str, url: str, compat: bool = False) -> str:
    """Why an address fits a site (null: it doesn't). `compat` compares the last two labels only, as decision D3 has it."""
    e, s = f"lower(trim(split_part({email}, '@', 2)))", host(d, url)
    # registrable domain: three labels under a second-level registry, else two
    reg = (lambda x: d.extract(x, "[^.]+\\.[^.]+$")) if compat else lambda x: d.extract(x, "[^.]+\\.(?:(?:co|org|ac|gov|nhs|me|ltd|plc)\\.[a-z]{2}|[^.]+)$")
    core = lambda x: d.rep(f"split_part({x}, '.', 1)", "[-_]")
    brand = lambda x: d.rep(core(x), any_of(sorted(R.BRAND_STEMS, key=len, reverse=True)))
    inside = lambda a, b: f"(length({a}) >= 4 AND length({b}) >= 4 AND (contains({a}, {b}) OR contains({b}, {a})))"
    return f"""CASE
        WHEN NOT {has_at(email)} OR coalesce({s}, '') = '' THEN NULL
        WHEN {e} = {s} THEN 'exact'
        WHEN {reg(e)} <> '' AND {reg(e)} = {reg(s)} THEN 'registrable'
        WHEN {d.word(e, R.FREE_PROVIDERS)} THEN 'free_mail'
        WHEN {inside(core(e), core(s))} THEN 'core'
        WHEN {inside(brand(e), brand(s))} THEN 'brand' END"""
