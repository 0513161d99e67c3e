"""Projections, predicates and cohort selection."""

from __future__ import annotations

from ..functions import rules as R
from ..functions.dialect import Dialect
from ..functions.emails import has_at
from ..functions.keys import blank, facebook, local, name_key, normal, social
from .core import operator

IDS = "lead_id, ingest_seq"


def note(d: Dialect, *marks: str) -> str:
    return d.some("refinement_notes", "x", d.holds("lower(x)", marks))


@operator("F1", "leads")
def target_sector(d):
    """Leads of a wanted sector: no excluded word in the sector or name, and any wanted one."""
    text = "lower(coalesce(sector, '') || ' ' || company_name)"
    return f"SELECT {IDS}, company_name FROM leads WHERE NOT {d.holds(text, R.OTHER_SECTOR_WORDS)} AND {d.holds(text, R.TARGET_SECTOR_WORDS)}"


@operator("F2", "leads")
def target_area(d):
    """Leads whose location names an area; empty locations pass."""
    return f"SELECT {IDS}, location FROM leads WHERE {blank('location')} IS NULL OR {d.holds('lower(location)', R.TARGET_AREAS)}"


@operator("F3", "leads")
def postcode_area(d):
    """Locations whose outward code is one of the wanted prefixes and goes on after it."""
    code = d.rep("upper(coalesce(location, ''))", "^.*, | ")
    return f"SELECT {IDS}, {code} AS postcode FROM leads WHERE {d.match(code, '^(' + '|'.join(R.POSTCODE_PREFIXES) + ').')}"


@operator("F4", "places")
def places_professional(d):
    """Open places without any type that contains an excluded token."""
    return f"SELECT place_id, display_name FROM places WHERE NOT {d.some('types', 't', d.holds('t', R.NOT_PROFESSIONAL))} AND coalesce(status, 'OPERATIONAL') = 'OPERATIONAL'"


@operator("F5", "places")
def places_wellness(d):
    """Places with a wellness type or name, whatever their status."""
    return f"SELECT place_id, display_name FROM places WHERE ({d.some('types', 't', d.holds('t', R.WELLNESS_TYPES))} OR {d.holds('lower(display_name)', R.WELLNESS_NAMES)})"


@operator("F6", "places")
def tag_place_clinic(d):
    """`clinic-target|town` or `wellness|town`."""
    return f"SELECT place_id, CASE WHEN {d.some('types', 't', d.holds('t', R.CLINIC_TYPES))} OR {d.holds('lower(display_name)', R.CLINIC_NAMES)} THEN 'clinic-target' ELSE 'wellness' END || '|' || town AS tag FROM places"


@operator("F7", "officers")
def active_officers(d):
    """Directors in office with a usable name."""
    return "SELECT company_number, pos, name, role FROM officers WHERE resigned_on IS NULL AND role IN ('director', 'managing-director', 'corporate-director') AND length(name) > 3 AND contains(name, ' ')"


@operator("F8", "companies")
def active_companies(d):
    """Companies whose status is none of the dead ones of their source."""
    dead = {"registry": ["dissolved"], "search": ["dissolved", "liquidation", "converted-closed"], "places": ["CLOSED_PERMANENTLY"]}
    return "SELECT company_key, source, status FROM companies WHERE NOT (" + " OR ".join(f"(source = {d.lit(s)} AND coalesce({d.word('status', words)}, false))" for s, words in dead.items()) + ")"


@operator("F9", "leads")
def qualified(d):
    """Every lead with whether it has an address and a name of over two characters."""
    return f"SELECT {IDS}, {has_at('email')} AND length(trim(coalesce(contact_name, ''))) > 2 AS qualified FROM leads"


@operator("F10", "leads")
def needs_enrichment(d):
    """Leads without contact or email, and whether they are fully enriched by the second rule."""
    full = f"contact_name IS NOT NULL AND email IS NOT NULL AND {d.size('contact_names')} > 0 AND (generic_email IS NOT NULL OR {d.size('personal_email_guesses')} > 0)"
    return f"SELECT {IDS}, contact_name IS NULL OR email IS NULL AS needs_basic, NOT ({full}) AS needs_full FROM leads"


@operator("F11", "leads")
def web_presence(d):
    """Leads without website and Facebook page are excluded, with reason and lowest confidence."""
    real = f"(website IS NOT NULL AND NOT {social(d, 'website')})"
    out = f"NOT ({real} OR {facebook(d, 'website')})"
    return f"SELECT {IDS}, {out} AS excluded, CASE WHEN {out} THEN 'no_web_presence' END AS excluded_reason, CASE WHEN {out} THEN 1.0 ELSE CAST(confidence_score AS DOUBLE) END AS confidence, CASE WHEN {out} THEN 'do_not_email' END AS mailshot FROM leads"


def _search_text(category: str | None = "office", least: int | None = 5, search: str = "wok", geo: str = "local_review") -> str:
    """The rule as plain text for comparison, without the library's spellings."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    tests = [f"category = {quoted(category)}"] if category else []
    tests += [f"ai_score >= {least}"] if least is not None else []
    tests += [f"strpos(lower(concat_ws(chr(10), company_name, sector, location)), {quoted(search.lower())}) > 0"] if search else []
    tests += ["(geo_relevance IS NULL OR geo_relevance <> 'exclude')"] if geo == "local_review" else [f"geo_relevance = {quoted(geo)}"] if geo else []
    return f"SELECT {IDS}, company_name, ai_score FROM leads WHERE {' AND '.join(tests) or 'true'}"


@operator("F12", "leads")
def search_leads(d, category: str | None = "office", least: int | None = 5, search: str = "wok", geo: str = "local_review"):
    """Dashboard search: one text looked for in company, sector and location; category, least score and geography only where they are given.

    `geo` is a relevance, or `local_review` for all that are not excluded.  A lead
    without score has none to compare and goes where a least score is asked.
    """
    if d.duck:
        return _search_text(category, least, search, geo)
    hits = " OR ".join(f"contains(lower(coalesce({c}, '')), {d.lit(search.lower())})" for c in ("company_name", "sector", "location"))
    tests = [f"category = {d.lit(category)}" if category else "", f"ai_score >= {least}" if least is not None else "", f"({hits})" if search else "", "coalesce(geo_relevance, '') <> 'exclude'" if geo == "local_review" else f"geo_relevance = {d.lit(geo)}" if geo else ""]
    return f"SELECT {IDS}, company_name, ai_score FROM leads WHERE {' AND '.join(t for t in tests if t) or 'true'}"


@operator("F13", "leads")
def hide_excluded(d):
    """Office leads that are not excluded by geography; unknown ones show."""
    return f"SELECT {IDS} FROM leads WHERE category = 'office' AND coalesce(geo_relevance, '') <> 'exclude'"


def cohort_tests(d) -> dict[str, str]:
    name, mail = normal(d, "contact_name"), normal(d, "email")
    soc = d.holds("lower(website)", ["facebook.com", "fb.com", "instagram.com", "twitter.com"])
    return {"A": f"{name} IS NULL AND website IS NOT NULL AND NOT {soc}", "B": f"{name} IS NOT NULL AND confidence_score <= 3", "C": f"{mail} IS NOT NULL AND coalesce(email_guessed, false)"}


def not_fresh(day: str, force: bool) -> str:
    """Not enriched on the day (unless forced) and not given up; never enriched and never judged leads count as neither."""
    fresh = "true" if force else f"coalesce(last_enriched_date <> DATE '{day}', true)"
    return f"{fresh} AND NOT coalesce(missing_name_final, false)"


def _cohort_text(day: str, force: bool) -> str:
    """The rule as plain text for comparison."""
    absent = lambda c: f"({c} IS NULL OR lower(trim({c})) IN ('', 'nan', 'none'))"
    return f"""SELECT lead_id, ingest_seq, unnest(list_filter([CASE WHEN no_name AND site <> '' AND NOT regexp_matches(site, 'facebook[.]com|fb[.]com|instagram[.]com|twitter[.]com') THEN 'A' END,
            CASE WHEN NOT no_name AND confidence_score <= 3 THEN 'B' END, CASE WHEN NOT no_mail AND email_guessed IS TRUE THEN 'C' END], lambda x: x IS NOT NULL)) AS cohort
        FROM (SELECT *, {absent('contact_name')} AS no_name, {absent('email')} AS no_mail, lower(coalesce(website, '')) AS site FROM leads
            WHERE missing_name_final IS DISTINCT FROM true AND ({str(force).lower()} OR last_enriched_date IS DISTINCT FROM DATE '{day}')) t"""


@operator("F14", "leads")
def cohorts(d, day: str = "2024-06-05", force: bool = False):
    """Cohort A (no contact), B (low confidence) or C (guessed email) of each lead that has not been given up nor, unless forced, enriched on the day."""
    if d.duck:
        return _cohort_text(day, force)
    return " UNION ALL ".join(f"SELECT {IDS}, '{c}' AS cohort FROM leads WHERE {not_fresh(day, force)} AND {t}" for c, t in cohort_tests(d).items())


def rescrape(d: Dialect, retry: bool) -> str:
    mail = normal(d, "email")
    done = note(d, "email_rescrape_done", "email_rescrape_no_email", "email_rescrape_timeout", "email_rescrape_error", "website_email_not_found", "rescrape_skipped")
    bad = f"coalesce({d.holds('lower(email)', R.BAD_EMAILS)}, false)"
    guessed = "coalesce(email_guessed, false)"
    again = f"""WHEN {done} AND {note(d, 'rescrape_v4')} THEN 'already_rescrape_v4'
        WHEN {done} AND {mail} IS NULL THEN 'retry_no_email'
        WHEN {done} AND ({guessed} OR coalesce(email_type = 'guessed', false)) THEN 'retry_guessed'
        WHEN {done} AND {bad} THEN 'retry_bad_pattern'
        WHEN {done} THEN 'retry_skip_has_email'""" if retry else f"WHEN {done} THEN 'already_rescrape_done'"
    return f"""CASE WHEN {normal(d, 'website')} IS NULL THEN 'no_website'
        WHEN {social(d, 'website')} THEN 'social_only'
        WHEN {note(d, 'email_replaced_from_website')} THEN 'already_replaced'
        {again}
        WHEN {mail} IS NULL THEN 'no_email'
        WHEN {guessed} THEN 'email_guessed_true'
        WHEN email_type = 'guessed' THEN 'email_type_guessed'
        WHEN {bad} THEN 'bad_pattern'
        WHEN contains(lower({d.join('personal_email_guesses', ' | ')}), lower(trim(email))) THEN 'email_in_personal_guesses'
        WHEN email_type = 'both' THEN 'email_type_both' ELSE 'not_qualifying' END"""


@operator("F15", "leads")
def rescrape_reason(d):
    """First reason to look for an email again or not, without and with retry."""
    return f"SELECT {IDS}, {rescrape(d, False)} AS reason, {rescrape(d, True)} AS retry_reason FROM leads"


def js_reason(d) -> str:
    """Why a lead's own site, not yet rendered, should be (null: it should not)."""
    why = f"CASE WHEN {normal(d, 'email')} IS NULL THEN 'missing' WHEN coalesce(email_guessed, false) THEN 'guessed' WHEN {d.word(local('email'), R.GENERIC_LOCALS)} THEN 'generic' END"
    return f"CASE WHEN website IS NOT NULL AND NOT {social(d, 'website')} AND NOT {note(d, 'js_scrape_v1')} THEN {why} END"


@operator("F16", "leads")
def js_targets(d, most: int = 25):
    """First leads, in order, to render: own website, not yet rendered, email missing, guessed or generic."""
    return f"SELECT * FROM (SELECT {IDS}, {js_reason(d)} AS reason FROM leads) t WHERE reason IS NOT NULL ORDER BY ingest_seq LIMIT {most}"


@operator("F17", "leads")
def lookup_targets(d):
    return f"SELECT {IDS} FROM leads WHERE website IS NULL AND NOT {d.has('enrichment_source', d.lit('places_lookup'))}"


@operator("F18", "leads")
def geo_targets(d):
    return f"SELECT {IDS} FROM leads WHERE geo_relevance IS NULL OR (website IS NOT NULL AND {d.has('enrichment_source', d.lit('places_lookup'))})"


@operator("F19", "leads")
def heading_targets(d):
    return f"SELECT {IDS} FROM leads WHERE {normal(d, 'contact_name')} IS NULL AND website IS NOT NULL AND NOT (enrichment_attempts > 0 AND {d.has('enrichment_source', d.lit('website_team_heading'))})"


@operator("F20", "leads")
def registry_targets(d):
    return f"SELECT {IDS} FROM leads WHERE principal_name IS NULL AND {blank('company_name')} IS NOT NULL"


@operator("F21", "leads", "existing")
def discovery_sample(d, most: int = 100):
    """First leads without website whose name no earlier sample holds."""
    return f"""SELECT l.lead_id, l.ingest_seq FROM leads l LEFT JOIN (SELECT DISTINCT {name_key('company_name')} AS seen FROM existing) e ON {name_key('l.company_name')} = e.seen
        WHERE e.seen IS NULL AND l.website IS NULL AND NOT {d.has('l.enrichment_source', d.lit('website_discovery'))} ORDER BY l.ingest_seq LIMIT {most}"""


@operator("F22", "leads")
def missing_name(d):
    return f"SELECT {IDS} FROM leads WHERE {normal(d, 'contact_name')} IS NULL"


@operator("F23", "leads")
def social_url(d):
    """Whether the website is a social page, and the Facebook page found in the website, else the enrichment source."""
    return f"SELECT {IDS}, {social(d, 'website')} AS is_social, CASE WHEN {facebook(d, 'website')} THEN website WHEN {d.some('enrichment_source', 'x', facebook(d, 'x'))} THEN {d.at(d.filter('enrichment_source', 'x', facebook(d, 'x')), '1')} END AS facebook_page FROM leads"


@operator("F24", "leads")
def bad_email_pattern(d):
    return f"SELECT {IDS}, email FROM leads WHERE {d.holds('lower(email)', R.BAD_EMAILS)} OR {d.some(d.array(R.BAD_GUESS_PREFIXES), 'p', d.starts(local('email'), 'p'))}"


def guess_flag(d: Dialect) -> str:
    return f"CASE WHEN NOT coalesce(email_guessed, false) OR email IS NULL THEN NULL WHEN {d.some(d.array(R.BAD_GUESS_PREFIXES), 'p', d.starts(local('email'), 'p'))} THEN 'bad_guess_pattern' WHEN {blank('website')} IS NOT NULL OR {has_at('generic_email')} THEN 'guessed_with_website' END"


@operator("F25", "leads")
def guessed_email(d):
    return f"SELECT * FROM (SELECT {IDS}, {guess_flag(d)} AS reason FROM leads) t WHERE reason IS NOT NULL"


@operator("F26", "leads")
def unreachable(d):
    """Leads given up on: two attempts and still no contact; unknown attempts are none."""
    gone = f"coalesce(enrichment_attempts, 0) >= 2 AND {normal(d, 'contact_name')} IS NULL"
    return f"SELECT {IDS}, {gone} AS missing_final, CASE WHEN {gone} THEN 'missing_name_final' ELSE enrichment_status END AS status FROM leads"


@operator("F27", "leads")
def llm_targets(d, most_calls: int = 3):
    """Requests by kind: cleanup (a name was removed, none is left, and there is a site), sanitise (a name that is no garbage and has low confidence without the registry behind it, or fails the contact test), waterfall (contact or email missing, and calls left)."""
    from ..functions.names import contact_valid
    from .texts import garbage

    name = normal(d, "contact_name")
    doubtful = f"(coalesce(confidence_score <= 3 AND coalesce(contact_source, '') <> 'companies_house', false) OR NOT coalesce({contact_valid(d, 'contact_name')}, false))"
    return f"""SELECT {IDS}, 'cleanup' AS kind FROM leads WHERE {name} IS NULL AND {blank('website')} IS NOT NULL AND {note(d, 'cleanup_fake_removed', 'no_named_individual_found')}
        UNION ALL SELECT {IDS}, 'sanitise' AS kind FROM leads WHERE {name} IS NOT NULL AND ({garbage(d)}) IS NULL AND {doubtful}
        UNION ALL SELECT {IDS}, 'waterfall' AS kind FROM leads WHERE ({name} IS NULL OR {normal(d, 'email')} IS NULL) AND coalesce(enrichment_attempts, 0) < {most_calls}"""
