"""Composite jobs: each is one lineage built from the operators' rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import emails as E
from ..functions import names as N
from ..functions.dialect import quote
from ..functions.keys import blank, facebook, host, normal, social
from ..operators import arrival, filters, joins, merges, texts, windows
from ..operators.core import job, operator


def refined(d) -> str:
    """Leads of one category after the refinement rules, one sub-select a rule, each rule's columns bound before the next reads them."""
    own, other, company = windows.promoted_contact(d, texts.company_person(d))
    cols = "lead_id, contact_name, email, generic_email, website_verified, personal_email_guesses, team_email_guesses, principal_name, principal_guess, phone, ai_score, contact_email, refinement_notes, email_type, missing_email, name_review_needed, facebook_url"
    first = windows.best(d, ["*"], windows.banded(d, "(SELECT * FROM leads WHERE category = 'unit8')"), windows.name_domain_key(d), "band", "leads")
    page = d.filter("enrichment_source", "x", facebook(d, "x"))
    listed = lambda a: f"{d.size(a)} > 0"
    note = lambda test, text: f"CASE WHEN {test} THEN {d.wrap(text)} ELSE {d.text_array()} END"
    web = f"""SELECT k.*, website IS NOT NULL AND trim(website) <> '' AND NOT {social(d, 'website')} AS real_site, CASE WHEN {facebook(d, 'website')} THEN website WHEN {listed(page)} THEN {d.at(page, '1')} END AS facebook_url FROM ({first}) k"""
    principal = f"""SELECT w.*, CASE WHEN real_site THEN {host(d, 'website')} ELSE '' END AS site, CASE WHEN real_site THEN 'yes' WHEN facebook_url IS NOT NULL THEN 'facebook' ELSE 'no' END AS verified,
        CASE WHEN NOT bad THEN known END AS principal, CASE WHEN NOT bad THEN guess END AS principal_mail FROM (SELECT w.*, p.known, p.guess, coalesce({d.starts(N.verdict(d, 'p.known'), d.lit('invalid'))}, true) AND p.known IS NOT NULL AS bad
            FROM ({web}) w LEFT JOIN (SELECT lead_id AS own_id, nullif(principal_name, '') AS known, nullif(principal_guess, '') AS guess FROM ({joins.fill_principals.sql(d)}) f) p ON p.own_id = w.lead_id) w"""
    named = f"SELECT n.*, split_part({N.verdict(d, 'own')}, ':', 1) AS own_verdict FROM (SELECT r.*, {own} AS own, {other} AS other, {company} AS company FROM ({principal}) r) n"
    chosen = f"""SELECT c.*, CASE WHEN own_verdict = 'valid' THEN own ELSE coalesce(other, company, own) END AS contact, CASE WHEN own IS NULL OR own = '' THEN CASE WHEN coalesce(other, company) IS NULL THEN 'none' ELSE 'valid' END WHEN other IS NULL AND company IS NULL THEN own_verdict ELSE 'valid' END AS validity,
        {E.generic(d, 'email')} AS shared, {E.gibberish(d, 'email')} AS odd, own_verdict <> 'valid' AND other IS NULL AND company IS NOT NULL AS from_company FROM ({named}) c"""
    mailed = f"""SELECT m.*, CASE WHEN NOT coalesce(shared, false) AND NOT coalesce(odd, false) THEN email END AS kept_email, coalesce({blank('generic_email')}, CASE WHEN site <> '' THEN 'info@' || site END, CASE WHEN shared THEN email END) AS generic,
        {E.has_at('email')} AND NOT coalesce(shared, false) AND NOT coalesce(odd, false) AND contact IS NOT NULL AND NOT {E.matches_contact(d, 'email', 'contact')} AS strange, {E.guesses(d, 'contact', 'site')} AS made,
        {texts.team_of(d, 'contact', 'site')} AS team FROM ({chosen}) m"""
    guessed = f"""SELECT g.*, CASE WHEN validity IN ('valid', 'review') AND {listed('made')} THEN made ELSE personal_email_guesses END AS personal, CASE WHEN {listed('contact_names')} AND site <> '' THEN team ELSE team_email_guesses END AS team_list,
        coalesce(lower(trim(contact)) = lower(trim(principal)), false) AS one_person FROM ({mailed}) g"""
    settled = f"""SELECT t.*, CASE WHEN one_person AND NOT {listed('personal')} AND principal_mail IS NOT NULL THEN {d.wrap('principal_mail')} ELSE personal END AS guesses, CASE WHEN NOT one_person THEN principal_mail END AS principal_left FROM ({guessed}) t"""
    typed = f"""SELECT lead_id, contact AS contact_name, kept_email AS email, generic AS generic_email, verified AS website_verified, guesses AS personal_email_guesses, team_list AS team_email_guesses, principal AS principal_name, principal_left AS principal_guess, phone, ai_score, kept_email AS contact_email, facebook_url,
        refinement_notes || {note('from_company', "'contact_from_company_name:' || contact")} || {note('odd AND NOT shared', "'gibberish_email_cleared:' || email")} || {note('strange', "'email_contact_mismatch:' || email")} AS refinement_notes,
        CASE WHEN {E.has_at('kept_email')} THEN CASE WHEN generic IS NOT NULL THEN 'both' ELSE 'personal' END WHEN generic IS NOT NULL THEN CASE WHEN {listed('guesses')} THEN 'both' ELSE 'generic' END WHEN {listed('guesses')} THEN 'personal' END AS email_type,
        kept_email IS NULL AND generic IS NULL AND NOT {listed('guesses')} AND principal_left IS NULL AND NOT {listed('team_list')} AS missing_email, validity IN ('review', 'invalid') OR strange AS name_review_needed FROM ({settled}) f"""
    points = f"SELECT {cols}, website_verified = 'no' AS excluded, {texts.data_points(d)} AS points FROM ({typed}) y"
    return f"""SELECT lead_id, contact_name, name_review_needed, website_verified, facebook_url, principal_name, principal_guess, contact_email, generic_email, {d.join('personal_email_guesses', ' | ')} AS personal_guesses, {d.join('team_email_guesses', ' | ')} AS team_guesses, email_type, missing_email, points,
        CASE WHEN points >= 7 THEN 'high' WHEN points >= 4 THEN 'medium' ELSE 'low' END AS data_score, excluded, CASE WHEN excluded THEN 'no website and no Facebook page' END AS excluded_reason, {d.join(f"refinement_notes || {note('excluded', d.lit('excluded:no_web_no_fb'))}", '; ')} AS notes FROM ({points}) z"""


@operator("P1", "leads", "existing")
def refine(d):
    """Leads of one category: deduplicated by the band of their unrefined data, then web presence, known principals (doubtful ones dropped), contact, addresses (shared ones moved, made-up ones cleared, strange ones noted), guesses, type, missing address and score of the refined data; those without web presence are excluded."""
    return refined(d)


def outputs(leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables that refine() is for: enriched leads, and excluded ones."""
    return leads.where("NOT excluded").drop("excluded", "excluded_reason"), leads.where("excluded")


@operator("P2", "officers", "leads", "existing", "company_codes")
def sweep(d):
    """New registry companies with sector, latest director and status, less the known ones."""
    return f"""SELECT l.lead_id, s.sector, o.name AS director, {d.rep(N.person_format(d, 'coalesce(o.name, chr(32))'), '\\s+', ' ')} AS contact, CASE WHEN o.name IS NULL THEN 'missing_name' WHEN l.email IS NULL THEN 'missing_email' ELSE 'complete' END AS status
        FROM leads l JOIN ({joins.anti_existing_office.sql(d)}) n ON n.lead_id = l.lead_id LEFT JOIN ({joins.sector_from_sic.sql(d)}) s ON s.company_number = l.lead_id LEFT JOIN ({windows.latest_director.sql(d)}) o ON o.company_number = l.lead_id"""


def _own(d) -> str:
    """All rows of the leads that are offices."""
    return "SELECT lead_id, company_name, contact_name, location, category, email, contact_email, generic_email, email_guessed, website, size_signal, date_of_creation FROM leads WHERE lead_id IN (SELECT lead_id FROM leads WHERE category = 'office')"


def _own_pages(d) -> str:
    """Signals of the pages that are sites of such leads."""
    return texts.geo_page(d, "(SELECT url, html, text FROM page_text WHERE url IN (SELECT website FROM own))", f"{texts.team_page(d)} AS team, ")


def _of_own(sql: str) -> str:
    """The statement with these leads as its leads."""
    return f"SELECT * FROM (WITH leads AS (SELECT * FROM own) {sql}) of_own"


OFFICE_SIDES = {"own": _own, "own_pages": _own_pages} | {n: lambda d, build=build: _of_own(build(d)) for n, build in joins.LINK_SIDES.items()}


@operator("P3", "leads", "places", "page_text", sides=OFFICE_SIDES)
def office_enrich(d):
    """Place, size, strategy and status of each office lead. Only offices are linked, and only their pages searched, each once."""
    size, geo, link, own = texts.size_signal.sql(d), texts.geo_relevance.sql(d), joins.link_places.sql(d), "leads"
    if not d.duck:
        link, own = _of_own(link), "own"
        size, geo = _of_own(texts.size_of(d, "SELECT url, team FROM own_pages")), _of_own(texts.geo_of(d, "SELECT * FROM own_pages"))
    text = f"""SELECT l.lead_id, m.place_id, z.size_signal, CASE z.size_signal WHEN 'larger' THEN 'site_team' WHEN 'established_small' THEN 'director_guess' ELSE 'generic_only' END AS strategy, g.geo, {texts.office_status(d)} AS status
        FROM {own} l LEFT JOIN ({link}) m ON m.lead_id = l.lead_id JOIN ({size}) z ON z.lead_id = l.lead_id JOIN ({geo}) g ON g.lead_id = l.lead_id WHERE l.category = 'office'"""
    if d.duck or d.staged:
        return text
    return f"SELECT * FROM (WITH own AS ({_own(d)}), own_pages AS ({_own_pages(d)}) {text}) offices"


def judged(d, source: str) -> str:
    """Rows of `source` with whether the contact is valid, found once."""
    return f"SELECT *, {N.contact_valid(d, 'contact_name')} AS contact_ok FROM ({source}) own_rows"


def outcome(d) -> str:
    """Status, type, confidence and segment, as columns over judged() rows."""
    return f"{texts.status(d, 'contact_ok')} AS status, {texts.email_type(d)} AS email_type, {texts.confidence(d, 'contact_ok')} AS confidence, {texts.mailshot(d)} AS segment"


SCORED = ["email_guessed", "generic_email", "contact_email", "contact_names", "personal_email_guesses", "team_email_guesses", "principal_name", "principal_email_guess", "website", "website_verified", "refinement_notes", "company_name"]


@operator("P4", "leads", "page_text", "officers", "controllers")
def waterfall_enrich(d):
    """Contact and email by source: own, then the site's page, then the registry; status, type, confidence and segment after. Complete leads stay as they are."""
    kept = ", ".join(f"l.{c}" for c in SCORED)
    base = f"""SELECT l.lead_id, coalesce({normal(d, 'l.contact_name')}, r.principal) AS contact_name, CASE WHEN {normal(d, 'l.contact_name')} IS NOT NULL THEN 'own' WHEN r.principal IS NOT NULL THEN 'registry' END AS contact_source,
        coalesce(l.email, p.email) AS email, CASE WHEN l.email IS NOT NULL THEN 'own' WHEN p.email IS NOT NULL THEN 'website' END AS email_source, {kept}
        FROM leads l LEFT JOIN (SELECT url, {d.at('mails', '1')} AS email FROM (SELECT url, {E.found(d, 'text')} AS mails FROM page_text) m) p ON p.url = l.website LEFT JOIN (SELECT lead_id, principal FROM ({joins.principal_for_lead.sql(d)}) j) r ON r.lead_id = l.lead_id"""
    return f"SELECT lead_id, {outcome(d)}, contact_name, contact_source, email_source FROM ({judged(d, base)}) t"


@operator("P5", "leads", "page_text")
def fast_path(d):
    """Only the landed home page, and only for leads whose director's name is valid."""
    if d.duck:
        return f"SELECT l.lead_id, {d.at(E.found(d, 'p.text'), '1')} AS email, {d.size(d.split('p.text', '\\s+'))} AS words FROM leads l JOIN (SELECT url, text FROM page_text) p ON p.url = l.website WHERE {N.contact_valid(d, 'l.principal_name')}"
    # a page is searched once, not for each of its leads, and only what was found is joined
    page = f"SELECT url, {d.at('mails', '1')} AS email, words FROM (SELECT url, {E.found(d, 'text')} AS mails, {d.size(d.split('text', '\\s+'))} AS words FROM page_text) m"
    return f"SELECT l.lead_id, p.email, p.words FROM leads l JOIN ({page}) p ON p.url = l.website WHERE {N.contact_valid(d, 'l.principal_name')}"


@operator("P6", "leads", "page_text")
def surgical(d):
    """One cohort with fresh status, type, confidence, finality and attempts."""
    own = f"SELECT lead_id, {texts.status(d)} AS status, {texts.confidence(d)} AS confidence, enrichment_attempts + 1 AS attempts, enrichment_attempts + 1 >= 2 AND {normal(d, 'contact_name')} IS NULL AS missing_final FROM leads"
    return f"SELECT l.lead_id, c.cohort, l.status, l.confidence, l.attempts, l.missing_final FROM ({own}) l JOIN ({filters.cohorts.sql(d)}) c ON c.lead_id = l.lead_id"


@operator("P7", "leads", "found_emails", "verdicts")
def cleanup(d):
    """Doubtful names and guessed emails resolved: reasons, outcomes, what is left, and its status, type, confidence and segment; a model's verdict names those that nothing else does."""
    kept = ", ".join(f"l.{c}" for c in SCORED if c != "email_guessed")
    base = f"""SELECT l.lead_id, n.reason AS r1, l.r2, CASE WHEN n.contact_name IS NULL AND v.outcome = 'found' THEN 'found_by_verdict' ELSE n.action END AS name_action,
        CASE WHEN n.contact_name IS NULL AND v.outcome = 'found' THEN v.contact_name ELSE n.contact_name END AS contact_name, CASE WHEN l.r2 IS NULL THEN l.email ELSE e.email END AS email, CASE WHEN l.r2 IS NULL THEN l.email_guessed ELSE e.email_guessed END AS email_guessed, {kept}
        FROM (SELECT *, {filters.guess_flag(d)} AS r2 FROM leads) l JOIN ({windows.resolve_contact.sql(d)}) n ON n.lead_id = l.lead_id JOIN (SELECT lead_id, email, email_guessed FROM ({merges.replaced_email(d)}) x) e ON e.lead_id = l.lead_id
        LEFT JOIN (SELECT lead_id, outcome, contact_name FROM ({merges.verdict_rules.sql(d)}) x) v ON v.lead_id = l.lead_id WHERE n.reason IS NOT NULL OR l.r2 IS NOT NULL"""
    return f"SELECT lead_id, r1, r2, name_action, contact_name, email, {outcome(d)}, {normal(d, 'contact_name')} IS NULL AS missing_name FROM ({judged(d, base)}) t"


@operator("P8", "leads", "verdicts")
def sanitise(d):
    """Garbage names cleared, names inferred from the company where there is none, answers applied; all targets from one snapshot. With the type and status after."""
    kept = ", ".join(f"g.{c}" for c in SCORED)
    named = "CASE WHEN g.reason IS NULL THEN g.contact_name ELSE i.name END"
    base = f"""SELECT g.lead_id, g.reason, CASE WHEN v.verified = false AND v.contact_name IS NULL AND g.reason IS NULL THEN NULL ELSE {named} END AS contact_name, g.reason IS NOT NULL AND i.name IS NOT NULL AS inferred, g.email, {kept}
        FROM (SELECT *, {texts.garbage(d)} AS reason FROM leads) g LEFT JOIN ({texts.names_from_company.sql(d)}) i ON i.lead_id = g.lead_id LEFT JOIN ({joins.apply_verdicts.sql(d)}) v ON v.lead_id = g.lead_id"""
    return f"SELECT lead_id, reason, contact_name, inferred, {texts.status(d, 'contact_ok')} AS status, {texts.email_type(d)} AS email_type, contact_name IS NULL AS missing_name FROM ({judged(d, base)}) t"


@operator("P9", "leads", "found_emails")
def rescrape(d):
    """Qualifying leads with their reason, the found address's fit to the site, and the email after."""
    return f"""SELECT r.lead_id, r.reason, {E.domain_match(d, 'e.email', 'l.website')} AS fit, e.email, e.action, 'email_rescrape_done' AS mark FROM (SELECT lead_id, {filters.rescrape(d, False)} AS reason FROM leads) r
        JOIN ({merges.replaced_email(d)}) e ON e.lead_id = r.lead_id JOIN leads l ON l.lead_id = r.lead_id WHERE r.reason IN ('no_email', 'email_guessed_true', 'email_type_guessed', 'bad_pattern', 'email_in_personal_guesses', 'email_type_both')"""


@operator("P10", "leads", "page_text", "places", sides=joins.LINK_SIDES)
def discover_websites(d):
    """Sites by candidate and by place, the better-validated first."""
    return f"""SELECT l.lead_id, a.url, a.confidence, m.place_id, CASE WHEN a.url IS NOT NULL THEN 'slug' WHEN m.place_id IS NOT NULL THEN 'place' ELSE 'unresolved' END AS layer FROM leads l LEFT JOIN ({windows.accept_domain.sql(d)}) a ON a.lead_id = l.lead_id
        LEFT JOIN ({joins.link_places.sql(d)}) m ON m.lead_id = l.lead_id"""


@operator("P11", "leads_dup", "leads")
def batch_enrich(d):
    """Deduplicated leads that need enrichment, by status."""
    kept = f"SELECT * FROM leads WHERE lead_id IN (SELECT lead_id FROM ({windows.dedupe_keep_enriched.sql(d)}) k)"
    return f"SELECT status, count(*) AS n FROM (SELECT {texts.status(d)} AS status FROM ({kept}) l WHERE contact_name IS NULL OR email IS NULL) t GROUP BY status"


def _town(town: str) -> str:
    return f"split_part(location, ',', 1) = {quote(town)}"


def _validated(d, source: str) -> str:
    """Rows with an address and a name, with their score band."""
    return f"SELECT lead_id, CASE WHEN ai_score >= 7 THEN 'high' WHEN ai_score >= 4 THEN 'medium' ELSE 'low' END AS band FROM {source} WHERE {E.has_at('email')} AND length(trim(coalesce(contact_name, ''))) > 2"


def _town_sql(d, town: str = "Woking") -> str:
    fresh = joins.unknown(d, f"(SELECT * FROM leads_dup WHERE {_town(town)})", "l.*")
    return _validated(d, f"(SELECT * FROM leads_dup WHERE ingest_seq IN (SELECT ingest_seq FROM ({arrival.arrivals_sql(f'({fresh}) f')}) k)) t")


@job("P12", "leads_dup", "existing", plain=_town_sql)
def ingest_town(leads_dup: DataFrame, existing: DataFrame, town: str = "Woking") -> DataFrame:
    """New rows of a town in order of arrival: none that shares a place, website or name and location with a known lead or an earlier new row; of those, the ones with email and name, with their score band."""
    own = {k: F.expr(v) for k, v in arrival.lead_keys().items()}
    rows = leads_dup.where(_town(town))
    seen = arrival.exploded(existing.select(*(e.alias(k) for k, e in own.items())), list(own)).distinct()
    kept = arrival.first_arrivals(rows.select("ingest_seq", *(e.alias(k) for k, e in own.items())), list(own), "ingest_seq", seen)
    stay = rows.join(kept, "ingest_seq", "left_semi")
    return stay.where(f"{E.has_at('email')} AND length(trim(coalesce(contact_name, ''))) > 2").select("lead_id", F.expr("CASE WHEN ai_score >= 7 THEN 'high' WHEN ai_score >= 4 THEN 'medium' ELSE 'low' END").alias("band"))
