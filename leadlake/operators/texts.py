"""Text, URL and HTML jobs over leads, pages and documents."""

from __future__ import annotations

from ..functions import emails as E
from ..functions import names as N
from ..functions import rules as R
from ..functions.keys import blank, domain, host, lead_key, letters, local, name_key, name_location_key, normal, social, tokens, vowels, website_key
from .core import operator


@operator("T1", "mailed_documents")
def extract_emails(d):
    """Every address of each document by its position, from 0."""
    rows = f"SELECT doc_id, {E.found(d, 'text')} AS found FROM mailed_documents WHERE contains(text, '@')"
    each = "CAST(generate_subscripts(found, 1) - 1 AS INT) AS pos, unnest(found) AS email" if d.duck else "posexplode(found) AS (pos, email)"
    return f"SELECT doc_id, {each} FROM ({rows}) f"


@operator("T2", "doc_emails")
def clean_emails(d, compat: bool = False):
    """Each address of a document as both jobs clean it (null: rejected); `compat` cuts the domain at its leftmost known ending."""
    return f"SELECT doc_id, email AS raw, {E.cleaned(d, 'email', compat)} AS email, {E.cleaned_strictly(d, 'email')} AS strict_email FROM doc_emails"


def decoded(d, code: str) -> str:
    """A protected address: the first byte is the key of all others."""
    key = d.from_hex(f"substr({code}, 1, 2)")
    last = f"CAST(floor(length({code}) / 2) AS INT)"
    return d.join(d.map(d.sequence("2", last), "i", f"chr({d.xor(d.from_hex(f'substr({code}, CAST(2 * i - 1 AS INT), 2)'), key)})"), "")


@operator("T3", "rich_pages")
def protected_emails(d):
    """Protected addresses, as found in attributes or links of each page, decoded."""
    hexes = d.extract_all("html", "(?:data-cfemail=\"|email-protection#)([0-9a-f]{6,})", 1)
    return f"SELECT page_id, email FROM (SELECT page_id, {decoded(d, 'code')} AS email FROM (SELECT page_id, {d.explode(hexes)} AS code FROM rich_pages) a) b WHERE contains(email, '@')"


@operator("T4", "rich_pages")
def page_emails(d):
    """Addresses of each page by source rank: links, then protected ones, then raw text; junk and overlong ones dropped."""
    link = d.extract_all("html", "(?i)mailto:([a-z0-9._%+-]+@[a-z0-9.-]+)", 1)
    hexes = d.extract_all("html", "(?:data-cfemail=\"|email-protection#)([0-9a-f]{6,})", 1)
    raw = d.extract_all("html", "(?i)([a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,7})", 1)
    rows = f"SELECT page_id, 1 AS source_rank, {d.explode(link)} AS email FROM rich_pages UNION ALL SELECT page_id, 2 AS source_rank, {decoded(d, 'code')} AS email FROM (SELECT page_id, {d.explode(hexes)} AS code FROM rich_pages) a UNION ALL SELECT page_id, 3 AS source_rank, {d.explode(raw)} AS email FROM rich_pages"
    return f"SELECT page_id, lower(email) AS email, min(source_rank) AS source_rank FROM ({rows}) t WHERE contains(email, '@') AND length(email) <= 254 AND length({local('email')}) <= 64 AND NOT {d.holds('lower(email)', R.CLEAN_JUNK)} GROUP BY page_id, lower(email)"


@operator("T5", "rich_pages")
def jsonld_emails(d):
    """Addresses inside the linked-data scripts of each page."""
    bodies = d.extract_all("html", "(?is)<script[^>]*ld\\+json[^>]*>(.*?)</script>", 1)
    mails = d.extract_all(d.join(bodies, " "), "\"email\"\\s*:\\s*\"(?:mailto:)?([^\"]+@[^\"]+)\"", 1)
    return f"SELECT page_id, {d.size(bodies)} AS scripts, {d.join(mails, ';')} AS emails FROM rich_pages"


@operator("T6", "leads")
def email_kind(d):
    """The two rules for shared mailboxes, and free mail."""
    return f"SELECT lead_id, CASE WHEN NOT {E.has_at('email')} THEN '' WHEN {E.generic(d, 'email')} THEN 'generic' ELSE 'personal' END AS kind, {E.generic_prefix(d, 'email')} AS generic_prefix, {E.free_mail(d, 'email')} AS free_mail FROM leads"


@operator("T7", "leads")
def gibberish_emails(d):
    return f"SELECT lead_id, email FROM leads WHERE {E.gibberish(d, 'email')}"


@operator("T8", "leads")
def email_contact_mismatch(d):
    return f"SELECT lead_id, {E.matches_contact(d, 'email', 'contact_name')} AS matches FROM leads"


@operator("T9", "leads")
def email_guesses(d):
    """Guessed addresses of each contact in pattern order, a known one (an address that is not guessed) first; each once."""
    known = f"lower(trim(CASE WHEN NOT coalesce(email_guessed, false) AND {E.has_at('email')} THEN email END))"
    made = E.guesses(d, "contact_name", host(d, "website"))
    first = f"CASE WHEN {d.match(known, E.GUESS)} THEN {d.wrap(known)} ELSE {d.text_array()} END"
    g = f"CASE WHEN {d.size(made)} > 0 THEN {d.distinct(f'({first} || {made})')} ELSE {d.text_array()} END"
    if d.duck:
        return f"SELECT lead_id, unnest(range(1, len(g) + 1)) AS place, unnest(g) AS email FROM (SELECT lead_id, {g} AS g FROM leads) t"
    return f"SELECT lead_id, CAST(p + 1 AS BIGINT) AS place, email FROM (SELECT lead_id, posexplode({g}) AS (p, email) FROM leads) t"


def team_of(d, contact: str, site: str) -> str:
    """`name: address` of each further contact that is not doubtful, as an array."""
    name = N.without_titles(d, "w")
    ok = d.filter("contact_names", "w", f"lower(w) <> lower(coalesce({contact}, '')) AND NOT {d.starts(N.verdict(d, 'w'), d.lit('invalid'))} AND {d.size(E.guesses(d, name, site))} > 0")
    return d.map(ok, "w", name + " || ': ' || " + d.at(E.guesses(d, name, site), "1"))


@operator("T10", "leads")
def team_guesses(d):
    """`name: address` of each valid further contact."""
    return f"SELECT lead_id, {d.join(team_of(d, 'contact_name', host(d, 'website')), ' | ')} AS guesses FROM leads WHERE website IS NOT NULL"


@operator("T11", "leads")
def reconcile_guesses(d):
    """Where contact and principal are one, the principal's guess is dropped, or moved if the contact has none."""
    same = "coalesce(lower(trim(contact_name)) = lower(trim(principal_name)), false)"
    n = d.size("personal_email_guesses")
    return f"SELECT lead_id, CASE WHEN {same} THEN NULL ELSE principal_email_guess END AS principal_guess, CASE WHEN {same} AND {n} = 0 THEN coalesce(principal_email_guess, '') ELSE {d.join('personal_email_guesses', ';')} END AS personal FROM leads"


@operator("T12", "leads")
def email_domain_match(d, compat: bool = False):
    return f"SELECT lead_id, {E.domain_match(d, 'email', 'website', compat)} AS reason FROM leads"


@operator("T13", "leads")
def name_verdicts(d):
    """Verdict and rule of each contact name."""
    v = N.verdict(d, "contact_name")
    return f"SELECT lead_id, split_part(v, ':', 1) AS verdict, split_part(v, ':', 2) AS rule FROM (SELECT lead_id, {v} AS v FROM leads) t"


@operator("T14", "leads")
def contact_validity(d):
    return f"SELECT lead_id, {N.contact_valid(d, 'contact_name')} AS valid FROM leads"


def like_name(d, x: str) -> str:
    """Whether a text could be a person's name: two to five words, the core ones capitalised letters and none excluded; then a known first name, or vowels in every word and a first word in title case."""
    w = N.words(d, x)
    plain = d.rep("w", "['.-]")
    core = d.filter(w, "w", f"NOT {d.word(d.rep('lower(w)', '^[.,()]+|[.,()]+$'), [*R.LIKENESS_TITLES, *R.LIKENESS_SUFFIXES])}")
    first = d.rep(d.at("core", "1"), "['-]")
    odd = d.some("core", "w", f"length({plain}) >= 2 AND NOT {d.match(plain, '^[A-Z][a-zA-Z]*$')}")
    barred, dry = d.some("core", "w", d.word("lower(w)", R.LIKENESS_EXCLUDED)), d.some("core", "w", f"length({plain}) >= 3 AND NOT {d.match(f'lower({plain})', '[aeiouy]')}")
    rest = f"NOT {odd} AND NOT {barred} AND ({d.word(f'lower({first})', R.FIRST_NAMES)} OR (NOT {dry} AND {d.match(first, '^[A-Z][a-z.]*[a-z][a-z.]*$')}))"
    whole = f"[{core}]" if d.duck else f"array({core})"  # bound once, so that the tests name it
    return f"coalesce(length({x}) BETWEEN 4 AND 60 AND {d.size(w)} BETWEEN 2 AND 5 AND {d.some(whole, 'core', f"{d.size('core')} >= 2 AND {rest}")}, false)"


@operator("T15", "leads")
def name_likeness(d):
    """Whether each contact could be a person's name."""
    return f"SELECT lead_id, {like_name(d, 'contact_name')} AS like_name FROM leads"


@operator("T16", "leads")
def suspicious_names(d):
    return f"SELECT lead_id, {N.suspicious(d, 'contact_name')} AS suspicious FROM leads"


@operator("T17", "leads")
def vanity_names(d):
    """The name is the company's; the second rule exempts valid names."""
    return f"SELECT lead_id, {N.vanity(d, 'contact_name', 'company_name')} AS vanity, NOT {N.contact_valid(d, 'contact_name')} AND {N.vanity(d, 'contact_name', 'company_name', R.ECHO_STOP)} AS echo FROM leads"


@operator("T18", "leads")
def domain_names(d):
    return f"SELECT lead_id, {N.domain_name(d, 'contact_name', host(d, 'website'))} AS is_domain FROM leads"


@operator("T19", "leads")
def strip_titles(d):
    return f"SELECT lead_id, {N.without_titles(d, 'contact_name')} AS name FROM leads WHERE contact_name IS NOT NULL"


#: First names that the last clean-up of names knows.
SANITISE_KNOWN = list(dict.fromkeys([*R.FIRST_NAMES, *R.SANITISE_NAMES]))


def company_person(d) -> str:
    """Name at the front of a practitioner's company (null: none): two or three capitalised words after titles and before service words, a known first name, a valid verdict."""
    seg = d.rep(d.rep(d.rep("company_name", "\\s+[-–|]\\s+.*$"), "\\s*\\([^)]*\\)\\s*$"), "\\s*&\\s+\\w+$")
    whole = f"trim({d.rep(d.rep(seg, '(?i)(\\s+(' + '|'.join([*R.COMPANY_SUFFIXES, 'and', '&']) + '))+$'), '(?i)^((' + '|'.join(R.TITLES) + ')[.]?\\s+)+')})"
    name = "front"
    w = d.split(name, "\\s+")
    plain = d.match("w", "^[A-Z][a-zA-Z'-]*$")
    ok = f"{d.size(w)} BETWEEN 2 AND 3 AND NOT {d.some(w, 'w', f'NOT {plain}')} AND NOT {d.some(w, 'w', d.word('lower(w)', R.BUSINESS_WORDS))} AND {d.word(letters(d, d.at(w, '1')), [*R.FIRST_NAMES, *R.PRACTITIONER_NAMES])} AND {N.verdict(d, name)} = 'valid:'"
    return d.let(whole, name, f"CASE WHEN {ok} THEN {name} END")


def sole_trader(d) -> str:
    """Leading capitalised words of a sole trader's company up to a stop word (null: none); not for companies of many practitioners."""
    cn = d.rep(d.rep(d.rep("trim(company_name)", "\\s*[-–—]\\s*.+$"), "\\s*\\(.+\\)$"), ",\\s*.+$")
    w = d.split(cn, "\\s+")
    low = d.rep("lower(w)", "[.,]+$")
    stop = f"({d.word(low, [*R.SERVICE_SUFFIXES, *R.TRADER_QUALIFICATIONS, *R.TRADER_JOINS, *R.TRADER_OTHER_WORDS])} OR (NOT {d.match('w', '^[A-Z]')} AND NOT {d.word(low, ['de', 'la', 'le', 'von', 'van', 'mc', 'mac'])}))"
    names = d.slice(w, "1", f"{d.first(w, 'w', stop)} - 1")
    first, n = letters(d, d.at(names, "1")), d.size(names)
    last = f"lower({d.at(names, n)})"
    titled = d.word(first, ["dr", "mr", "mrs", "ms", "miss", "prof"])
    core = d.filter(names, "w", f"NOT {d.word('lower(w)', ['de', 'la', 'le', 'von', 'van', 'do'])}")
    fine = f"({N.contact_valid(d, d.join(names, ' '), R.SANITISE_SHORT_NAMES)} OR ({d.size(core)} >= 2 AND NOT {d.some(core, 'w', 'length(w) < 2')}) OR {d.size(d.filter(names, 'w', 'length(w) > 1'))} >= 2)"
    ok = f"NOT {d.some(d.split('lower(trim(company_name))', ' +'), 'w', d.word('w', R.MANY_PRACTITIONERS))} AND NOT {d.some(names, 'w', d.word(low, [*R.TRADER_PLACES, *R.MANY_PRACTITIONERS]))} AND {n} BETWEEN 2 AND 4 AND ({titled} OR ({d.word(first, SANITISE_KNOWN)} AND NOT {d.word(last, [*R.TRADER_PLACES, *R.GARBAGE_WORDS])} AND {fine}))"
    return f"CASE WHEN {ok} THEN {d.join(names, ' ')} END"


@operator("T20", "leads")
def names_from_company(d):
    """Names that companies' names give, by the practitioner rule and by the sole-trader rule."""
    return f"SELECT lead_id, coalesce(a, b) AS name, a IS NOT NULL AS practitioner FROM (SELECT lead_id, {company_person(d)} AS a, {sole_trader(d)} AS b FROM leads) t WHERE a IS NOT NULL OR b IS NOT NULL"


def garbage(d) -> str:
    """Why a name is garbage (null: it is not); `empty` for none."""
    n = f"lower({normal(d, 'contact_name')})"
    w = d.split(n, "\\s+")
    first = letters(d, d.at(w, "1"))
    known = d.word(first, SANITISE_KNOWN)
    alpha = letters(d, n)
    bad = d.some(w, "w", d.word("w", R.GARBAGE_WORDS))
    return f"""CASE WHEN {n} IS NULL THEN 'empty'
        WHEN {d.word(n, R.GARBAGE_EXACT)} THEN 'exact_garbage'
        WHEN {d.word(d.at(w, '1'), R.VERB_PREFIXES)} AND {d.size(w)} >= 2 AND NOT {known} THEN 'verb_prefix'
        WHEN {bad} AND NOT {known} THEN 'garbage_word'
        WHEN {known} AND {d.size(w)} = 2 AND {d.word(d.at(w, '2'), R.GARBAGE_WORDS)} THEN 'name_plus_garbage'
        WHEN {d.size(w)} = 2 AND {d.at(w, '1')} = {d.at(w, '2')} THEN 'duplicate_word'
        WHEN length({alpha}) >= 4 AND {vowels(d, alpha)} < 0.15 * length({alpha}) THEN 'gibberish'
        WHEN {d.match('contact_name', "'s\\s")} AND {d.size(w)} > 2 THEN 'possessive_phrase'
        WHEN {d.match('contact_name', "^(I'm |I am )")} THEN 'first_person'
        WHEN {N.contact_valid(d, 'contact_name', R.SANITISE_SHORT_NAMES)} OR ({d.word(first, ['dr', 'mr', 'mrs', 'ms', 'miss', 'prof'])} AND {d.size(w)} = 2) THEN NULL
        WHEN NOT {known} THEN 'failed_validation'
        WHEN {d.size(w)} = 2 AND {d.word(d.at(w, '2'), R.SERVICE_SUFFIXES)} THEN 'name_plus_service' END"""


@operator("T21", "leads")
def garbage_names(d):
    """Reason why a name is garbage, by count."""
    return f"SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT {garbage(d)} AS reason FROM leads) t GROUP BY 1"


@operator("T22", "leads")
def suspect_names(d):
    return f"SELECT lead_id, reason FROM (SELECT lead_id, {N.suspect(d, 'contact_name', 'company_name', 'refinement_notes', 'confidence_score')} AS reason FROM leads) t WHERE reason IS NOT NULL"


@operator("T23", "officers")
def registry_names(d):
    """Officer names as `Forenames Surname`, and with the first forename only."""
    full = N.person_format(d, "name")
    return f"SELECT pos, {full} AS name, {d.rep(full, '^(\\S+)\\s.*\\s(\\S+)$', '$1 $2')} AS short_name FROM officers"


def spelled(d, words) -> str:
    """Whether `low` holds one of the words, whole. The letters that words begin with are asked for first, and their first letters met once."""
    if d.duck:  # a plain search first: the slower pattern only runs on texts that hold one of the words
        return "((" + " OR ".join(f"contains(low, {d.lit(w)})" for w in words) + ") AND " + d.match("low", "\\b(?:" + "|".join(words) + ")\\b") + ")"
    heads = "".join("[" + "".join(sorted({w[i] for w in words} - {"-"})) + "-]" for i in range(3))
    by = {c: "|".join(w[1:] for w in words if w[0] == c) for c in dict.fromkeys(w[0] for w in words)}
    return d.match("low", f"(?={heads})\\b(?:" + "|".join(f"{c}(?:{rest})" for c, rest in by.items()) + ")\\b")


POST = "(?i)\\bGU[0-9]{1,2}\\s?[0-9][A-Z]{2}\\b"


def geo_signs(d) -> dict[str, str]:
    """Signals of a page by its `text` and `low`, the same in lower case; all but the first three read `rare`, whether it holds any of their words."""
    lists = {"x_exclude": R.EXCLUDE_TEXT, "x_shell": R.SHELL_TEXT, "x_dormant": R.DORMANT_TEXT, "x_scope": R.REVIEW_TEXT}
    first = {"has_text": "text <> ''", "text_post": f"(contains(low, 'gu') AND {d.match('text', POST)})", "text_town": spelled(d, [t.lower() for t in R.GEO_TOWNS])}
    return first | {n: spelled(d, words) if d.duck else f"(rare AND {spelled(d, words)})" for n, words in lists.items()}


def geo_page(d, source: str = "page_text", also: str = "") -> str:
    """Signals of each page, with the columns `also`."""
    signs = "SELECT url, " + also + ", ".join(f"{e} AS {n}" for n, e in geo_signs(d).items())
    if d.duck:
        return signs + f", {d.size(d.split('text', '\\s+'))} < 50 AS thin FROM (SELECT url, text, lower(text) AS low FROM {source}) low_text"
    kept = "SELECT *, " + spelled(d, R.EXCLUDE_TEXT + R.SHELL_TEXT + R.DORMANT_TEXT + R.REVIEW_TEXT) + f" AS rare FROM (SELECT *, lower(text) AS low FROM {source}) low_text"
    return signs + f", NOT {d.match('text', '^(?:\\S*+\\s++){49}')} AS thin FROM ({kept}) t"  # under 50 words


def geo_flags(d, page: str | None = None) -> str:
    """Signals of each lead and of its landed page; a page's signals are found once, before the join."""
    town = "(?i)\\b(?:" + "|".join(R.GEO_TOWNS) + ")\\b"
    loc, name = "coalesce(l.location, '')", "lower(l.company_name)"
    site, mail = host(d, "l.website"), "lower(split_part(l.generic_email, '@', 2))"
    flags = ", ".join(f"coalesce(p.{n}, false) AS {n}" for n in geo_signs(d))
    return f"""SELECT l.lead_id, l.website IS NOT NULL AS has_site, {flags}, {d.match(loc, POST)} AS loc_post, {d.match(loc, town)} AS loc_town, coalesce(p.thin, true) AS thin,
        coalesce({mail} <> {site} AND NOT {d.starts(mail, f"split_part({site}, '.', 1)")}, false) AS mismatch, {d.holds(name, R.SHELL_NAMES)} AS shell_name FROM leads l LEFT JOIN ({page or geo_page(d)}) p ON p.url = l.website"""


def geo_of(d, page: str | None = None) -> str:
    """geo_relevance(), with the pages' signals as geo_page() gives them."""
    flags = f"SELECT *, loc_post OR loc_town OR text_post OR text_town AS is_local FROM ({geo_flags(d, page)}) f"
    reasons = [
        ("loc_post", "gu_postcode_in_address"), ("text_post", "gu_postcode_on_website"), ("text_town", "surrey_location_on_website"), ("x_exclude", "exclude_keywords"), ("x_shell", "shell_or_holding_company"),
        ("x_dormant", "dormant_or_parked_website"), ("has_text AND x_scope AND NOT is_local", "national_or_international_scope"), ("has_text AND thin AND NOT is_local", "very_thin_website_content"), ("has_site AND NOT has_text", "no_website_content_available"),
        ("mismatch", "email_domain_mismatch"), ("shell_name AND NOT has_text", "shell_name_no_website"), ("shell_name AND has_text AND NOT is_local", "possible_shell_name"), ("NOT has_site AND NOT has_text AND NOT loc_post", "no_website_no_location_signal"),
    ]
    text = " || ".join(f"CASE WHEN {t} THEN '{n}; ' ELSE '' END" for t, n in reasons)
    strong = "(has_text AND NOT is_local AND (x_scope OR thin OR shell_name)) OR (has_site AND NOT has_text) OR (NOT has_site AND NOT has_text AND NOT loc_post)"
    review = f"x_dormant OR mismatch OR {strong}"
    return f"""SELECT lead_id, CASE WHEN x_exclude OR x_shell OR (shell_name AND NOT has_text) THEN 'exclude' WHEN ({review}) AND (NOT is_local OR {strong}) THEN 'review' WHEN is_local THEN 'local' ELSE 'review' END AS geo, {d.rep(text, '; $')} AS reasons FROM ({flags}) g"""


@operator("T24", "leads", "page_text")
def geo_relevance(d):
    """Local, review or exclude, with the reasons in order."""
    return geo_of(d)


def team_page(d, html: str = "html") -> str:
    """Whether a page tells of a team."""
    return d.match(f"coalesce({html}, '')", "(?i)href=\"[^\"]*(/team|/people|/our-team|/about-us/team|/meet-the-team|/staff|/about/team)[^\"]*\"|our team|meet the team|our people")


def size_of(d, page: str | None = None) -> str:
    """size_signal(), with the pages' `team` as `page` gives it; a page is searched once, not for each of its leads."""
    team, page = (team_page(d, "p.html"), "SELECT url, html FROM page_text") if d.duck else ("coalesce(p.team, false)", page or f"SELECT url, {team_page(d)} AS team FROM page_text")
    return f"SELECT l.lead_id, CASE WHEN l.size_signal IS NOT NULL AND l.website IS NOT NULL THEN l.size_signal WHEN l.website IS NULL OR {social(d, 'l.website')} THEN 'small_new' WHEN {team} THEN 'larger' WHEN l.date_of_creation < DATE '2021-03-01' THEN 'established_small' ELSE 'small_new' END AS size_signal FROM leads l LEFT JOIN ({page}) p ON p.url = l.website"


@operator("T25", "leads", "page_text")
def size_signal(d):
    """Known size, else no own site, a team page, or the year of creation."""
    return size_of(d)


def status(d, ok: str | None = None) -> str:
    """`ok` names a column that tells whether the contact is valid, if there is one."""
    ok, mail = ok or N.contact_valid(d, "contact_name"), E.has_at("email")
    return f"CASE WHEN {ok} AND {mail} THEN 'complete' WHEN {ok} THEN 'missing_email' WHEN {mail} THEN 'missing_name' ELSE 'incomplete' END"


def office_status(d) -> str:
    named = "(contact_name IS NOT NULL AND contact_name <> company_name)"
    some = "(email IS NOT NULL OR contact_email IS NOT NULL OR generic_email IS NOT NULL)"
    real = "((email IS NOT NULL AND NOT coalesce(email_guessed, false)) OR contact_email IS NOT NULL OR generic_email IS NOT NULL)"
    return f"CASE WHEN {real} AND {named} THEN 'complete' WHEN {some} AND {named} THEN 'guessed_email' WHEN {some} THEN 'missing_name' WHEN {named} THEN 'missing_email' ELSE 'incomplete' END"


@operator("T26", "leads")
def enrichment_status(d):
    return f"SELECT lead_id, {status(d)} AS status, {office_status(d)} AS office_status FROM leads"


def email_type(d) -> str:
    shared = f"({E.has_at('generic_email')} OR ({E.has_at('email')} AND {E.generic_prefix(d, 'email')}))"
    parts = d.split("lower(coalesce(contact_name, '') || ' ' || coalesce(principal_name, ''))", "\\s+")
    own = lambda m: f"({E.has_at(m)} AND NOT {E.generic_prefix(d, m)} AND ({d.some(parts, 'w', f'length(w) >= 3 AND contains({local(m)}, w)')} OR NOT coalesce(email_guessed, false)))"
    personal = f"({own('email')} OR {own('contact_email')})"
    guess = f"({d.size('personal_email_guesses')} > 0 OR {d.size('team_email_guesses')} > 0 OR (email IS NOT NULL AND coalesce(email_guessed, false)) OR principal_email_guess IS NOT NULL)"
    return f"CASE WHEN {personal} AND {shared} THEN 'both' WHEN {personal} THEN 'personal' WHEN {shared} THEN 'generic' WHEN {guess} THEN 'guessed' ELSE 'none' END"


@operator("T27", "leads")
def email_types(d):
    return f"SELECT lead_id, {email_type(d)} AS email_type FROM leads"


def confidence(d, ok: str | None = None, compat: bool = False) -> str:
    """`ok` names a column that tells whether the contact is valid, if there is one. `compat` takes only `true` for a verified site, as decision D14 has it."""
    p = lambda t, n: f"CASE WHEN {t} THEN {n} ELSE 0 END"
    ok = ok or N.contact_valid(d, "contact_name")
    first = d.rep(f"lower({d.at(N.words(d, 'coalesce(contact_name, chr(32))'), '1')})", "['-]")
    mark = lambda m: d.some("refinement_notes", "x", f"contains(x, '{m}')")
    points = [
        p(ok, 1), p(f"{ok} AND {d.word(first, R.FIRST_NAMES)}", 0.5), p(f"{ok} AND {d.match('lower(contact_name)', '^(dr|prof)[ .]')}", 0.5),
        f"CASE WHEN {E.has_at('email')} AND NOT {E.generic_prefix(d, 'email')} THEN 1 WHEN generic_email IS NOT NULL THEN 0.5 ELSE 0 END",
        f"CASE WHEN website IS NOT NULL AND {d.word('website_verified', ['true'] if compat else ['yes', 'true'])} THEN 1 WHEN website IS NOT NULL THEN 0.5 ELSE 0 END",
        p(f"{d.size('contact_names')} > 1", 0.5), p("principal_name IS NOT NULL", 0.5), p(f"{d.size('personal_email_guesses')} > 0", 0.5),
        p(f"{mark('possible_placeholder_name')} AND NOT {mark('suspicious_name_replaced')}", -1), p(mark("single_name_only"), -0.5),
    ]
    return f"CAST(least(5, greatest(1, {d.even('CAST(' + ' + '.join(points) + ' AS DOUBLE)')})) AS INT)"


@operator("T28", "leads")
def confidence_score(d, compat: bool = False):
    return f"SELECT lead_id, {confidence(d, compat=compat)} AS confidence FROM leads"


def mailshot(d) -> str:
    own = lambda m: f"({E.has_at(m)} AND NOT {E.generic_prefix(d, m)})"
    return f"CASE WHEN {own('email')} OR {own('contact_email')} OR {d.size('personal_email_guesses')} > 0 OR {d.size('team_email_guesses')} > 0 OR principal_email_guess IS NOT NULL THEN 'priority' WHEN {E.has_at('generic_email')} THEN 'fallback' ELSE 'do_not_email' END"


@operator("T29", "leads")
def mailshot_segment(d):
    return f"SELECT {mailshot(d)} AS segment, count(*) AS n FROM leads GROUP BY 1"


def data_points(d) -> str:
    mail = "coalesce(contact_email, email)"
    return f"""CASE website_verified WHEN 'yes' THEN 2 WHEN 'facebook' THEN 1 ELSE 0 END + CASE split_part({N.verdict(d, 'contact_name')}, ':', 1) WHEN 'valid' THEN 2 WHEN 'review' THEN 1 ELSE 0 END
        + CASE WHEN principal_name IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN {E.has_at(mail)} AND NOT {E.generic(d, mail)} THEN 2 WHEN generic_email IS NOT NULL THEN 1 ELSE 0 END
        + CASE WHEN {d.size('personal_email_guesses')} > 0 THEN 1 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN ai_score >= 7 THEN 1 ELSE 0 END"""


@operator("T30", "leads")
def data_score(d):
    return f"SELECT lead_id, points, CASE WHEN points >= 7 THEN 'high' WHEN points >= 4 THEN 'medium' ELSE 'low' END AS data_score FROM (SELECT lead_id, {data_points(d)} AS points FROM leads) t"


@operator("T31", "leads")
def notes(d):
    """Notes with a mark appended if it is absent, and earlier `geo:` notes replaced."""
    kept = d.filter("refinement_notes", "x", f"NOT {d.starts('x', d.lit('geo:'))}")
    one = d.join("refinement_notes", "; ")
    absent = f"NOT {d.some('refinement_notes', 'x', d.match('lower(x)', '^checked$'))}"
    return f"SELECT lead_id, {one} || CASE WHEN {absent} THEN CASE WHEN {d.size('refinement_notes')} > 0 THEN '; ' ELSE '' END || 'checked' ELSE '' END AS appended, {d.join(kept, '; ')} || CASE WHEN {d.size(kept)} > 0 THEN '; ' ELSE '' END || 'geo:' || coalesce(geo_relevance, 'review') AS replaced FROM leads"


@operator("T32", "documents")
def extract_facts(d):
    """Employee count, registry number, phone and company link of each text, first pattern that hits."""
    part = lambda p: f"nullif({d.extract('text', p, 1)}, '')"
    some = [d.number(part(p), "INT") for p in ("(?i)([0-9]{1,9})\\s*(?:[+]\\s*)?employees?", "(?i)team\\s*(?:of\\s*)?([0-9]{1,9})", "(?i)([0-9]{1,9})\\s*(?:member|staff|people)")]
    count = "coalesce(" + ", ".join(f"CASE WHEN {n} BETWEEN 1 AND 500 THEN {n} END" for n in some) + ")"
    codes = [part(p) for p in ("(?i)(?:company|co[.]?)\\s*(?:number|no[.]?|reg(?:istration)?[.]?)\\s*[:\\s]*([0-9]{6,8})", "(?i)(?:registered|registration)\\s*(?:number|no[.]?)\\s*[:\\s]*([0-9]{6,8})", "(?i)(?:companies?\\s+house)\\s*[:\\s]*(?:number|no[.]?)?\\s*[:\\s]*([0-9]{6,8})")]
    phone = f"nullif(trim({d.extract('text', '(?i)(?:tel|phone|call)[:\\s]*([0-9][0-9\\s()+-]{9,17})', 1)}), '')"
    link = f"nullif({d.extract('text', '(?i)linkedin[.]com/(?:company|in)/[a-z0-9-]+')}, '')"
    return f"SELECT doc_id, {count} AS employees, lpad(coalesce({', '.join(codes)}), 8, '0') AS number, {phone} AS phone, {link} AS link FROM documents"


def type_sector(d, mapping: dict, default: str) -> str:
    one = "CASE " + " ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in mapping.items()) + " END"
    hits = d.filter(d.map("types", "t", f"coalesce({one}, '')"), "t", "t <> ''")
    return f"coalesce({d.at(hits, '1')}, '{default}')"


@operator("T33", "places")
def sector_from_types(d):
    """Sector of the first type that holds a mapped key, keys in order, by both mappings."""
    return f"SELECT place_id, {type_sector(d, R.TYPE_SECTORS, 'Professional Services')} AS sector, {type_sector(d, R.WELLNESS_SECTORS, 'Health & Wellness')} AS wellness_sector FROM places"


def meta(d, name: str) -> str:
    """Content of the page's first meta tag of the name or property; empty if there is none."""
    tag = d.extract("html", f"(?is)<meta[^>]*(?:name|property)\\s*=\\s*[\\x22\\x27]{name}[\\x22\\x27][^>]*>")
    return " || ".join(d.extract(tag, f"(?is)content\\s*=\\s*{q}([^{q}]*){q}", 1) for q in ("\\x22", "\\x27"))


@operator("T34", "page_text")
def sector_text(d):
    """Sector of each page by its text, both descriptions and first two main headings."""
    from .windows import sector_points

    heads = d.rep(d.join(d.slice(d.extract_all("html", "(?is)<h1[^>]*>(.*?)</h1>", 1), "1", "2"), " "), "<[^>]*>", " ")
    whole = f"lower(text || ' ' || {meta(d, 'description')} || ' ' || {meta(d, 'og:description')} || ' ' || {heads})"

    points = sector_points(d, "t")
    cols = ", ".join(f"{p} AS p{i}" for i, (_, p) in enumerate(points))
    top = "greatest(" + ", ".join(f"p{i}" for i in range(len(points))) + ")"
    pick = " ".join(f"WHEN p{i} = {top} THEN {d.lit(n)}" for i, (n, _) in enumerate(points))
    return f"SELECT page_id, CASE WHEN {top} = 0 THEN 'General Wellness' {pick} END AS sector FROM (SELECT page_id, {cols} FROM (SELECT page_id, {whole} AS t FROM page_text) a) b"


@operator("T36", "page_text")
def page_texts(d):
    """Text, number of words and title of each page."""
    return f"SELECT page_id, text, {d.size(d.split('text', '\\s+'))} AS words, title FROM page_text"


def slug_words(d, company: str) -> str:
    """Words of a company's name without legal words and punctuation."""
    bare = d.rep(f"lower({company})", "\\b(ltd|limited|llp|plc|& co[.]?|and co[.]?|group|uk|[(]uk[)])\\b[.]?")
    return d.filter(d.split(f"trim({d.rep(bare, '[^a-z0-9 ]')})", " +"), "w", "w <> ''")


def significant(d, words: str) -> str:
    return d.filter(words, "w", f"length(w) > 2 AND NOT {d.word('w', R.SLUG_STOP)}")


def page_signs(d) -> str:
    """What each page says for itself as a company's site; found once a page."""
    geo = d.match("text", "(?i)\\bGU[0-9]|Surrey|Godalming|Guildford|Farnham|Woking|Haslemere\\b")
    return f"SELECT page_id, url, low, {d.holds('low', R.PARKED)} AS parked, {d.size(d.split('low', '\\s+'))} < 100 AS thin, {geo} AS geo FROM (SELECT page_id, url, text, lower(text) AS low FROM page_text) own_pages"


def validation(d, company: str, pattern: str) -> str:
    """Confidence in a page p (with its signs) as a company's site by a slug pattern."""
    named = d.some(significant(d, slug_words(d, company)), "w", "contains(p.low, w)")
    return f"CASE WHEN p.parked OR NOT {named} THEN 'reject' WHEN p.thin OR {pattern} IN (6, 7) THEN 'low' WHEN p.geo THEN 'high' ELSE 'medium' END"


@operator("T37", "page_text", "leads")
def validate_site(d):
    """Each lead's landed page as its site."""
    return f"SELECT l.lead_id, p.page_id, {validation(d, 'l.company_name', 'l.pattern')} AS confidence FROM (SELECT lead_id, website, company_name, site_pattern AS pattern FROM leads) l JOIN ({page_signs(d)}) p ON p.url = l.website"


def candidate_rows(d) -> str:
    """Candidate sites of each lead by slug pattern, ending and prefix, in order."""
    s1 = d.at("s", "1")
    forms = [
        ("a", "a <> ''"),
        ("b", "b <> a"),
        ("c", f"{d.size('s')} > 0 AND c <> a AND c <> b"),
        ("e", f"{d.size('s')} > 0 AND e <> a AND e <> b AND e <> {s1}"),
        ("f", f"{d.size('s')} >= 2 AND f <> a AND f <> c"),
        ("g", "length(g) >= 3"),
        (s1, f"length({s1}) >= 6 AND {s1} <> a AND {s1} <> b AND {s1} <> c AND {s1} <> e"),
    ]
    base = f"""SELECT lead_id, s, {d.join('w', '-')} AS a, {d.join('w', '')} AS b, {d.join('s', '-')} AS c, {d.join('s', '')} AS e, {d.join(d.slice('s', '1', '2'), '-')} AS f, {d.join(d.map('s', 'x', 'left(x, 1)'), '')} AS g
        FROM (SELECT lead_id, w, {significant(d, 'w')} AS s FROM (SELECT lead_id, {slug_words(d, 'company_name')} AS w FROM leads) x) y"""
    each = [f"CASE WHEN {test} AND length({slug}) >= 2 THEN {d.tuple(pattern=str(i), place=str(10 * i + 2 * j + k), url=f'{d.lit(front)} || {slug} || {d.lit("." + tld)}')} END" for i, (slug, test) in enumerate(forms, 1) for j, tld in enumerate(["co.uk", "com", "uk"] if i == 1 else ["co.uk", "com"]) for k, front in enumerate(("https://www.", "https://"))]
    made = ("[" if d.duck else "array(") + ", ".join(each) + ("]" if d.duck else ")")
    return f"SELECT lead_id, x.pattern AS pattern, x.place AS place, x.url AS url FROM (SELECT lead_id, {d.explode(made)} AS x FROM ({base}) z) q WHERE x IS NOT NULL"


@operator("T38", "leads")
def domain_candidates(d):
    return candidate_rows(d)


@operator("T39", "leads")
def name_overlap(d):
    """Share of the company's tokens in the contact's, and whether they differ."""
    a, b = tokens(d, "company_name", R.COMPANY_STOP), tokens(d, "coalesce(contact_name, '')", R.COMPANY_STOP)
    both = d.size(d.intersect(a, b))
    return f"SELECT lead_id, {d.even(f'1.0 * {both} / greatest({d.size(a)}, 1)', 4)} AS overlap, {both} < 0.5 * {d.size(b)} AS differ FROM leads"


def place_location(d, address: str, town: str) -> str:
    """The parts of an address around the first that names a known town, else its last three; the town where there is no address."""
    parts = d.map(d.split(address, ","), "x", "trim(x)")
    size, at = d.size(parts), d.first(parts, "x", d.holds("lower(x)", [t.lower() for t in R.PLACE_TOWNS]))
    around = d.slice(parts, f"greatest({at} - 1, 1)", f"{at} + 2 - greatest({at} - 1, 1)")
    return f"CASE WHEN coalesce({address}, '') = '' THEN {town} WHEN {at} <= {size} THEN {d.join(around, ', ')} WHEN {size} >= 2 THEN {d.join(d.slice(parts, f'greatest({size} - 2, 1)', '3'), ', ')} ELSE {address} END"


@operator("T40", "leads", "places")
def location_text(d):
    """Locations of leads, by the parts that are present, and of places, by the parts around a known town."""
    town, code = "nullif(trim(split_part(location, ',', 1)), '')", "nullif(trim(split_part(location, ',', 2)), '')"
    return f"SELECT 'lead' AS kind, lead_id AS id, concat_ws(', ', {town}, {code}) AS location FROM leads UNION ALL SELECT 'place' AS kind, place_id AS id, {place_location(d, 'address', 'town')} AS location FROM places"


@operator("T41", "leads")
def keys(d):
    """All keys of a lead."""
    return f"SELECT lead_id, {lead_key('company_name', 'email')} AS lead_key, {website_key(d, 'website')} AS website_key, {name_location_key('company_name', 'location')} AS name_location_key, {domain(d, 'website')} AS domain, lpad(lead_id, 8, '0') AS company_number FROM leads"


@operator("T42", "page_text")
def company_from_title(d):
    """Page title before the first separator, separators in order."""
    x = "title"
    for sep in (" - ", " | ", " – ", ": ", ". "):
        x = f"split_part({x}, '{sep}', 1)"
    return f"SELECT page_id, {x} AS company FROM page_text"


@operator("T43", "documents")
def normalise_text(d):
    """Texts with white space collapsed, as length and digest."""
    return f"SELECT doc_id, length(trim({d.rep('text', '\\s+', ' ')})) AS n, md5(trim({d.rep('text', '\\s+', ' ')})) AS digest FROM documents"


@operator("T44", "page_text")
def team_page_signal(d):
    """Whether a page links to a team page or says so."""
    paths = "(?i)href=\"[^\"]*(" + "|".join(R.TEAM_PATHS) + ")"
    return f"SELECT page_id, {d.match('html', paths)} OR {d.match('text', '(?i)meet the team|our team|our people')} AS signal FROM page_text"


REQUESTS = ("people", "name", "name_on_page", "contact", "extract", "score")


@operator("T45", "leads", "page_text")
def llm_requests(d, kinds=REQUESTS):
    """Request rows for an external scorer, one a lead and kind: context lines, then the beginning of the site's text as long as the kind takes."""
    line = lambda label, x, none="": f"'{label}: ' || coalesce(CAST({x} AS STRING), '{none}')"
    name, text = blank("l.contact_name"), "coalesce(p.text, '')"
    company, sector, site = line("Company", "l.company_name"), line("Sector", blank("l.sector"), "wellness/health"), line("Website", "l.website", "N/A")
    contact, score = line("Contact", name), line("Confidence", "l.confidence_score")
    lines = {
        "people": [company, sector, line("Website", "l.website"), f"left({text}, 2000)", "'Who owns, founded or leads this? FOUND: name | role, or NONE: reason'"],
        "name": [contact, company, sector, "'Is the contact a person? CONFIRMED, REJECTED or UNCERTAIN'"],
        "name_on_page": [company, contact, site, sector, f"left({text}, 1500)", "'Is the contact a person? REAL: reason, or FALSE: what it is'"],
        "contact": [company, contact, line("Email", "l.email", "None"), site, score, "'Is this the person to approach? YES or NO, and a reason'"],
        "extract": [company, f"left({text}, 2000)", "'Name of the owner and address, as JSON with name and email'"],
        "score": [company, f"left({line('Description', 'l.sector')}, 313)", line("Location", "l.location"), site],
    }
    needs = {"name": f"{name} IS NOT NULL", "name_on_page": f"{name} IS NOT NULL", "contact": f"{name} IS NOT NULL", "people": f"{text} <> ''", "extract": f"{text} <> ''"}
    made = [f"CASE WHEN {needs.get(k, 'true')} THEN {d.tuple(kind=d.lit(k), prompt=' || chr(10) || '.join(lines[k]))} END" for k in kinds]
    array = ("[" if d.duck else "array(") + ", ".join(made) + ("]" if d.duck else ")")
    rows = f"SELECT l.lead_id, {d.explode(array)} AS r FROM leads l LEFT JOIN (SELECT url, text FROM page_text) p ON p.url = l.website"
    return f"SELECT lead_id, r.kind AS kind, r.prompt AS prompt FROM ({rows}) q WHERE r IS NOT NULL"
