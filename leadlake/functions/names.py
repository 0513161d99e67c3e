"""Rules over person names, as SQL expressions."""

from __future__ import annotations

from . import rules as R
from .dialect import Dialect
from .keys import letters, vowels


def any_of(words) -> str:
    return "|".join(words)


def core(d: Dialect, words: str) -> str:
    """Words that are neither title nor qualification."""
    return d.filter(words, "w", f"NOT {d.word(d.rep('lower(w)', '\\.+$'), R.TITLES)} AND NOT {d.word(d.rep('lower(w)', '^[().,]+|[().,]+$'), R.QUALIFICATIONS)}")


def words(d: Dialect, name: str) -> str:
    return d.split(f"trim({name})", "\\s+")


def verdict(d: Dialect, name: str) -> str:
    """`verdict:rule` of a name: the first rule that speaks."""
    n = f"coalesce({name}, '')"
    w, c = "all_words", "core_words"
    joined = d.join(c, " ")
    alpha = d.rep(n, "[^a-zA-Z]")
    stripped = lambda x: d.rep(d.rep(f"lower({x})", "\\.+$"), "['s]+$")
    low = lambda x: letters(d, x)
    prefix = "^(mc|mac|van|von|de|o|al|el|ben|le|la|di)"
    # after the first name prefix that leaves at least two letters, else from the start
    lead = lambda x: f"({d.match(low(x), prefix + '[a-z]*[bcdfghjklmnpqrstvwxz]{4}')} AND {d.match(low(x), prefix + '[bcdfghjklmnpqrstvwxz]{4}')})"
    plain = lambda x: f"(NOT {d.match(low(x), prefix + '..')} AND {d.match(low(x), '^[bcdfghjklmnpqrstvwxz]{4}')})"
    triple = any_of(ch * 3 for ch in "abcdefghijklmnopqrstuvwxyz")
    rules = f"""CASE
        WHEN length(trim({n})) < 2 THEN 'invalid:short'
        WHEN {d.word(f'lower(trim({n}))', R.PLACEHOLDERS)} THEN 'invalid:placeholder'
        WHEN {d.size(w)} < 2 THEN 'invalid:one_word'
        WHEN {d.match(joined, '[0-9]')} THEN 'invalid:digit'
        WHEN {d.size(c)} < 1 THEN 'invalid:no_core'
        WHEN {d.size(c)} > 4 THEN 'review:many_words'
        WHEN {d.some(c, 'w', d.word(stripped('w'), R.BUSINESS_WORDS))} THEN 'invalid:business_word'
        WHEN {d.word(f'lower({d.at(w, d.size(w))})', R.JOB_WORDS)} THEN 'review:role_suffix'
        WHEN {d.match(f'trim({n})', '^(' + any_of(R.BRAND_PREFIXES) + ')\\b')} THEN 'invalid:brand_prefix'
        WHEN {d.some(c, 'w', f"length({low('w')}) >= 2 AND {vowels(d, low('w'))} = 0")} THEN 'invalid:vowelless'
        WHEN {d.some(c, 'w', f"length({low('w')}) >= 4 AND {vowels(d, low('w'))} < 0.15 * length({low('w')})")} THEN 'review:few_vowels'
        WHEN length({alpha}) < 4 AND NOT {d.some(c, 'w', d.word('lower(w)', R.SHORT_NAMES))} THEN 'invalid:few_letters'
        WHEN {d.match(alpha, '[^aeiouyAEIOUY]{6,}')} THEN 'review:consonant_run'
        WHEN {d.some(c, 'w', f'({lead("w")} OR {plain("w")})')} THEN 'review:leading_consonants'
        WHEN {d.some(c, 'w', d.match(low('w'), any_of(R.BIGRAMS) + '|' + any_of(R.TRIGRAMS)))} THEN 'review:odd_letters'
        WHEN {d.match(f'lower({alpha})', triple)} THEN 'review:triple_letter'
        ELSE 'valid:' END"""
    return d.let(words(d, n), w, d.let(core(d, w), c, rules))


def contact_valid(d: Dialect, name: str, short_names=R.CONTACT_SHORT_NAMES) -> str:
    """The stricter test that scores and status use."""
    n = f"lower(trim(coalesce({name}, '')))"
    kept = d.filter(d.split(n, "\\s+"), "w", f"NOT {d.word(d.rep('w', '\\.+$'), [t for t in R.TITLES if t not in ('lord', 'lady')])} AND NOT {d.word(d.rep('w', '^[().,]+|[().,]+$'), R.QUALIFICATIONS)}")
    c = "kept_words"
    joined = d.join(c, " ")
    low = lambda x: letters(d, x)
    rules = f"""(length({n}) >= 3 AND NOT {d.word(n, R.INVALID_NAMES)} AND NOT {d.word(n, R.NOUN_PLACEHOLDERS)}
        AND {d.size(c)} BETWEEN 2 AND 4
        AND NOT {d.some(c, 'w', f"length({low('w')}) <= 2 AND NOT {d.word(low('w'), short_names)}")}
        AND NOT {d.some(c, 'w', d.word('w', R.INVALID_NAMES))}
        AND NOT {d.holds(joined, R.INVALID_PHRASES)}
        AND {d.at(c, '1')} <> {d.at(c, '2')}
        AND NOT {d.match(joined, '[0-9]')}
        AND NOT {d.some(c, 'w', d.word(d.rep('w', "['s]+$"), R.CONTACT_BUSINESS_WORDS))}
        AND NOT {d.match(joined, "'s\\s+\\w")}
        AND NOT {d.some(c, 'w', f"length({low('w')}) >= 3 AND {vowels(d, low('w'))} = 0")}
        AND NOT {d.match(letters(d, joined), '[^aeiouy]{5,}')})"""
    return d.let(kept, c, rules)


def suspicious(d: Dialect, name: str, first_names=R.FIRST_NAMES) -> str:
    """Names that look made up; empty ones do too."""
    n = f"lower(trim(coalesce({name}, '')))"
    c = d.filter(d.split(n, "\\s+"), "w", f"w <> '' AND NOT {d.word(d.rep('w', '\\.+$'), ['dr', 'mr', 'mrs', 'ms', 'miss', 'prof', 'rev', 'sir', 'dame'])}")
    low = lambda x: letters(d, x)
    one = "|".join(f"^{ch}{{2,}}$" for ch in "abcdefghijklmnopqrstuvwxyz")
    first = low(d.at(c, "1"))
    return f"""(coalesce({d.size(c)}, 0) = 0
        OR {d.some(c, 'w', f"length({low('w')}) >= 3 AND {vowels(d, low('w'))} < 0.25 * length({low('w')})")}
        OR {d.some(c, 'w', d.match(low('w'), one))}
        OR coalesce(NOT {d.word(first, first_names)} AND {d.match(first, any_of(R.ODD_BIGRAMS) + '|' + any_of(R.ODD_TRIGRAMS))}, false)
        OR ({d.size(c)} >= 2 AND {d.at(c, '1')} = {d.at(c, '2')}))"""


def squeezed(d: Dialect, x: str) -> str:
    return f"trim({d.rep(f'lower({x})', '[^a-z\\s]')})"


def vanity(d: Dialect, name: str, company: str, stop=R.COMPANY_STOP) -> str:
    """The name is the company: equal, equal words but for stop words, or one inside the other."""
    a, b = squeezed(d, name), squeezed(d, company)
    aw, bw = (d.distinct(d.filter(d.split(x, "\\s+"), "w", f"w <> '' AND NOT {d.word('w', stop)}")) for x in (a, b))
    return f"""coalesce({a} <> '' AND {b} <> '' AND ({a} = {b}
        OR ({d.size(aw)} > 0 AND {d.size(aw)} = {d.size(bw)} AND {d.size(d.intersect(aw, bw))} = {d.size(aw)})
        OR (length({a}) > 3 AND (contains({b}, {a}) OR contains({a}, {b})))), false)"""


def domain_name(d: Dialect, name: str, site: str) -> str:
    """The name is the first label of the site's domain."""
    base = f"split_part({site}, '.', 1)"
    spaced = f"trim({d.rep(base, '[^a-z]', ' ')})"
    return f"coalesce({d.rep(f'lower(trim({name}))', ' ')} = {base} OR (lower(trim({name})) = {spaced} AND length({spaced}) > 3), false)"


def without_titles(d: Dialect, name: str) -> str:
    """Title, job and qualification words dropped; what follows a dash or bar is cut; the name stays if under two words are left."""
    bare = lambda x: d.rep(d.rep(f"lower({x})", "[.,;:]+$"), "^[()]+|[()]+$")
    kept = d.filter(words(d, d.rep(name, "\\s[-–|/]+(\\s.*)?$")), "w", f"NOT {d.word(bare('w'), [*R.TITLES, *R.JOB_WORDS, *R.QUALIFICATIONS])}")
    out = f"trim({d.rep(d.rep(d.join(kept, ' '), '\\s*[-–|/].*$'), '\\s*\\([^)]*\\)\\s*$')})"
    return f"CASE WHEN {d.size(words(d, out))} >= 2 THEN {out} ELSE trim({name}) END"


def person_format(d: Dialect, x: str) -> str:
    """`SURNAME, Forenames` as `Forenames Surname`, upper case after every non-letter."""
    full = f"trim(CASE WHEN contains({x}, ',') THEN trim(split_part({x}, ',', 2)) || ' ' || trim(split_part({x}, ',', 1)) ELSE {x} END)"
    marked = d.rep(f"lower({full})", "([^a-z]|^)([a-z])", "$1~$2")
    parts = d.split(marked, "~")
    up = d.map(parts, "w", "upper(left(w, 1)) || substr(w, 2)")
    return d.join(up, "")


def suspect(d: Dialect, name: str, company: str, notes: str, confidence: str) -> str:
    """Reason to doubt a stored contact name (null: none)."""
    n = f"trim(coalesce({name}, ''))"
    low = f"lower({n})"
    w = d.split(low, "\\s+")
    ok = contact_valid(d, name)
    one = d.filter(w, "w", f"NOT {d.word(d.rep('w', '\\.$'), ['dr', 'mr', 'mrs', 'ms', 'miss', 'prof'])}")
    ui = f"^({any_of(R.UI_STARTS)})\\b|\\b({any_of(R.UI_WORDS)})s?\\b|^({any_of(R.UI_FIRST)})\\b|\\b({any_of(R.UI_LEGAL)})\\b"
    role = f"^({any_of(R.ROLE_STARTS)})\\b|\\b(in|at|for|of)\\s+({any_of(R.ROLE_ENDS)})$|^({any_of(R.ROLE_BODIES)})\\s+"
    # a valid name that begins with a known first name is a person's, whatever street words it holds
    person = f"({ok} AND coalesce({d.word(d.rep(d.at(w, '1'), "['-]"), R.FIRST_NAMES)}, false))"
    return f"""CASE
        WHEN {n} = '' THEN NULL
        WHEN {d.word(low, R.UI_NAMES)} OR ({d.match(low, ui)} AND {d.size(w)} <= 3) THEN 'ui_artifact'
        WHEN NOT {person} AND ({d.some(w, 'w', d.word('w', [*R.STREET_WORDS, *R.PLACE_NAME_WORDS]))} OR {d.match(n, '\\b[A-Z]{1,2}[0-9]{1,2}\\b')}) THEN 'address_fragment'
        WHEN {d.match(low, role)} OR NOT {d.some(w, 'w', f"NOT {d.word('w', R.ROLE_WORDS)}")} THEN 'role_only_name'
        WHEN NOT {ok} AND {vanity(d, name, company, R.ECHO_STOP)} THEN 'company_name_echo'
        WHEN ({d.match(n, '[a-z][A-Z]')} AND length({n}) > 15) OR ({d.size(w)} >= 4 AND {d.some(d.split(n, '\\s+'), 'w', f"NOT {d.match('w', '^[A-Z]')}")}) THEN 'concatenated_text'
        WHEN {d.some(notes, 'x', d.holds('lower(x)', R.SUSPECT_NOTES))} THEN 'flagged_in_notes'
        WHEN {confidence} <= 2 THEN 'low_confidence'
        WHEN NOT {ok} THEN CASE WHEN {d.size(one)} = 1 THEN 'title_only' ELSE 'failed_validation' END
        END"""
