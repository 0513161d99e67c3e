"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..functions.emails import generic_prefix, has_at
from ..functions.keys import blank, facebook, normal, social
from ..functions.names import contact_valid, suspect
from ..sources.store import folder
from .core import job, operator
from .filters import cohort_tests, guess_flag, js_reason, not_fresh, note, rescrape
from .joins import LINK_SIDES, link_places

HAS_NAME = "contact_name IS NOT NULL"


def share(d, n: str, total: str = "count(*)", digits: int = 1) -> str:
    return d.even(f"100.0 * {n} / greatest({total}, 1)", digits)


@operator("A1", "leads")
def lead_stats(d):
    """Thirteen counts, mean score and confidence and completeness by category and over all, in one pass with grouping sets."""
    c = lambda t, n: f"count_if({t}) AS {n}"
    full = f"{HAS_NAME} AND email IS NOT NULL"
    return f"""SELECT coalesce(category, 'all') AS category, count(*) AS total, {c('email IS NOT NULL', 'with_email')}, {c(HAS_NAME, 'with_contact')}, {c('phone IS NOT NULL', 'with_phone')}, {c('website IS NOT NULL', 'with_website')},
        {c('generic_email IS NOT NULL', 'with_generic')}, {c(f"{d.size('personal_email_guesses')} > 0", 'with_guesses')}, {c('principal_name IS NOT NULL', 'with_principal')}, {c('contact_verified', 'verified')}, {c('email_guessed', 'guessed')},
        {c('missing_name_final', 'final')}, {c("enrichment_status = 'complete'", 'complete')}, {c('ai_score >= 7', 'high_score')}, {c(f"{d.size('team_email_guesses')} > 0", 'with_team')},
        coalesce({d.even('avg(ai_score)', 1)}, 0.0) AS avg_score, coalesce({d.even('avg(confidence_score)', 1)}, 0.0) AS avg_confidence, {share(d, f'count_if({full})')} AS pct_complete
        FROM leads GROUP BY GROUPING SETS ((category), ())"""


@operator("A2", "leads")
def email_type_histogram(d):
    return "SELECT coalesce(email_type, 'none') AS email_type, count(*) AS n FROM leads GROUP BY 1"


@operator("A3", "leads")
def refinement_stats(d):
    """Counts over leads with a web presence (a site of their own or a Facebook page), and how many have none."""
    c = lambda t, n: f"count_if(web AND {t}) AS {n}"
    return f"""SELECT count_if(web) AS enriched, count_if(NOT web) AS excluded, {c('email_type = ' + d.lit('personal'), 'personal')}, {c('email_type = ' + d.lit('both'), 'both')}, {c('email_type = ' + d.lit('generic'), 'generic')}, {c('email IS NULL', 'missing_email')},
        {c('contact_name IS NULL', 'missing_name')}, {c('principal_name IS NOT NULL', 'principals')}, {c("website_verified = 'yes'", 'site_yes')}, {c("website_verified = 'facebook'", 'site_facebook')}, {c(d.size('contact_names') + ' > 1', 'multiple')}, {c(d.size('team_email_guesses') + ' > 0', 'team')}, {c('ai_score >= 7', 'ai_high')}
        FROM (SELECT *, {blank('website')} IS NOT NULL AND NOT {social(d, 'website')} OR {facebook(d, 'website')} AS web FROM leads) t"""


@operator("A4", "leads")
def refine_summary(d):
    c = lambda t, n: f"count_if({t}) AS {n}"
    return f"SELECT {c('contact_name IS NULL', 'name_review')}, {c('email IS NULL', 'missing_email')}, {c(d.size('contact_names') + ' > 0', 'with_contacts')}, {c(d.size('personal_email_guesses') + ' > 0', 'with_guesses')}, {c('confidence_score >= 4', 'high')}, {c('confidence_score BETWEEN 2 AND 3.99', 'medium')}, {c('confidence_score < 2', 'low')} FROM leads"


@operator("A5", "leads")
def office_summary(d):
    """Totals (real addresses are those less the guessed ones) and breakdowns by geography, status and size in rows (section, key, n), in one pass."""
    sections = {"geo": "coalesce(geo_relevance, 'unclassified')", "status": "coalesce(enrichment_status, 'unknown')", "size": "coalesce(size_signal, 'unclassified')"}
    one = lambda test: f"CASE WHEN {test} THEN 1 ELSE 0 END"
    totals = {"leads": "1", "with_email": one("email IS NOT NULL"), "guessed": one("coalesce(email_guessed, false)"), "real_email": f"{one('email IS NOT NULL')} - {one('coalesce(email_guessed, false)')}"}
    each = ", ".join([*(d.tuple(section=f"'{s}'", key=k, one="1") for s, k in sections.items()), *(d.tuple(section="'total'", key=f"'{k}'", one=v) for k, v in totals.items())])
    rows = d.explode(("[" if d.duck else "array(") + each + ("]" if d.duck else ")"))
    return f"SELECT x.section AS section, x.key AS key, CAST(sum(x.one) AS BIGINT) AS n FROM (SELECT {rows} AS x FROM leads WHERE category = 'office') t GROUP BY 1, 2"


@operator("A6", "leads")
def sweep_summary(d):
    """Counts with whole percents rounded down, and the mean score."""
    p = lambda n: f"CAST(floor(count_if({n}) * 100.0 / greatest(count(*), 1)) AS BIGINT)"
    return f"SELECT count(*) AS total, count_if(email IS NOT NULL) AS emails, {p('email IS NOT NULL')} AS pct_email, count_if({HAS_NAME}) AS contacts, {p(HAS_NAME)} AS pct_contact, {d.even('avg(ai_score)', 1)} AS mean_score FROM leads"


def suspect_reason(d):
    return suspect(d, "contact_name", "company_name", "refinement_notes", "confidence_score")


@operator("A7", "leads")
def suspect_report(d):
    """Flagged leads by reason, and of those the ones with a website; names and emails flagged twice count once in `any`."""
    each = ("[" if d.duck else "array(") + "r1, r2, CASE WHEN r1 IS NOT NULL OR r2 IS NOT NULL THEN 'any' END" + ("]" if d.duck else ")")
    rows = f"(SELECT website, {suspect_reason(d)} AS r1, {guess_flag(d)} AS r2 FROM leads)"
    return f"SELECT reason, count(*) AS n, count_if(website IS NOT NULL) AS with_website FROM (SELECT website, {d.explode(each)} AS reason FROM {rows} a) t WHERE reason IS NOT NULL GROUP BY reason"


@operator("A8", "leads")
def sanitise_projection(d):
    """Garbage names by reason and in all; names that would be inferred, what would be left with its share, addresses to look at, and the final counts."""
    from .texts import garbage, sole_trader

    named = f"{normal(d, 'contact_name')} IS NOT NULL"
    settled = d.some("refinement_notes", "x", d.holds("lower(x)", ["final_human_filter", "openai_name_validation:rejected"]))
    rows = f"""SELECT named, CASE WHEN NOT named THEN 'no_name' ELSE coalesce(why, 'kept') END AS reason, named AND why IS NOT NULL AS bad, NOT named AND NOT settled AND guess IS NOT NULL AS inferred, guessed, verified, traced
        FROM (SELECT {named} AS named, {garbage(d)} AS why, {sole_trader(d)} AS guess, {settled} AS settled, coalesce(email_guessed AND email IS NOT NULL AND website IS NOT NULL, false) AS guessed, coalesce(contact_verified, false) AS verified, coalesce(contact_source = 'sole_trader_inference', false) AS traced FROM leads) a"""
    left = "(count_if(named) - count_if(bad) + count_if(inferred))"
    return f"""SELECT CASE WHEN grouping(reason) = 1 THEN 'all' ELSE reason END AS reason, count(*) AS total, count_if(named) AS with_name, count_if(bad) AS garbage, count_if(inferred) AS inferred, {left} AS projected, {share(d, left)} AS pct, count_if(guessed) AS guessed_emails,
        count_if(verified AND named) AS final_verified, count_if(traced) AS final_inferred, count_if(NOT named) AS final_missing FROM ({rows}) b GROUP BY GROUPING SETS ((reason), ())"""


@operator("A9", "leads")
def dataset_stats(d, day: str = "2024-06-05"):
    """Coverage and the sizes of the cohorts, in one pass."""
    sizes = ", ".join(f"count_if({not_fresh(day, False)} AND {t}) AS cohort_{c.lower()}" for c, t in cohort_tests(d).items())
    return f"""SELECT count(*) AS total, {share(d, f'count_if({normal(d, "contact_name")} IS NOT NULL)')} AS pct_contact, {share(d, 'count_if(email IS NOT NULL)')} AS pct_email, count_if(confidence_score <= 3) AS low_confidence, count_if(missing_name_final) AS final, {sizes} FROM leads"""


@operator("A10", "leads")
def geo_stats(d):
    return "SELECT count_if(geo_relevance = 'local') AS local, count_if(geo_relevance = 'review') AS review, count_if(geo_relevance = 'exclude') AS excluded, count_if(geo_relevance IS NULL) AS unclassified, count(*) AS total FROM leads"


@operator("A11", "leads")
def rescrape_reason_counts(d):
    """Reasons by falling count, then name."""
    return f"SELECT reason, count(*) AS n FROM (SELECT {rescrape(d, False)} AS reason FROM leads) t GROUP BY reason ORDER BY n DESC, reason"


@operator("A12", "leads")
def js_scrape_stats(d):
    """Leads to render by reason and in all, with the share that has an address and how many have been rendered."""
    rows = f"SELECT coalesce({js_reason(d)}, 'no_target') AS reason, {normal(d, 'email')} IS NOT NULL AS mailed, {note(d, 'js_scrape_v1')} AS done FROM leads"
    return f"SELECT CASE WHEN grouping(reason) = 1 THEN 'all' ELSE reason END AS reason, count(*) AS n, count_if(mailed) AS with_email, {share(d, 'count_if(mailed)')} AS pct_email, count_if(done) AS done FROM ({rows}) t GROUP BY GROUPING SETS ((reason), ())"


@operator("A13", "leads", "page_text")
def discovery_funnel(d, price: float = 0.019):
    """Attempts by slug pattern and in all: resolved, graded by the landed page, rejected by reason; false positives, cost of the calls for what is left, and the same projected to all leads without a site."""
    from .texts import page_signs, validation

    page = f"SELECT s.* FROM ({page_signs(d)}) s JOIN (SELECT min(page_id) AS page_id FROM page_text GROUP BY url) f ON f.page_id = s.page_id"
    grade = f"CASE WHEN l.website IS NULL THEN 'unresolved' WHEN p.page_id IS NULL THEN 'no_page' WHEN p.parked THEN 'parked' ELSE {validation(d, 'l.company_name', 'l.site_pattern')} END"
    rows = f"SELECT l.site_pattern AS pattern, {grade} AS grade FROM leads l LEFT JOIN ({page}) p ON p.url = l.website"
    n = lambda *of: f"count_if({d.word('grade', of)})"
    bad, good, left = n("no_page", "parked", "reject"), n("high", "medium"), f"(count(*) - {n('high', 'medium', 'low')})"
    return f"""SELECT CASE WHEN grouping(pattern) = 1 THEN 'all' ELSE CAST(pattern AS STRING) END AS pattern, count(*) AS attempted, count_if(grade <> 'unresolved') AS resolved, {n('high', 'medium', 'low')} AS validated, {n('high')} AS high, {n('medium')} AS medium, {n('low')} AS low,
        {n('reject')} AS no_name_match, {n('parked')} AS parked, {n('no_page')} AS get_failed, {share(d, bad, "count_if(grade <> 'unresolved')")} AS pct_false, {left} AS calls, {d.even(f'{price} * {left}', 3)} AS cost,
        CAST(floor(1.0 * {n('unresolved')} * {good} / greatest(count(*), 1)) AS BIGINT) AS projected_sites, {d.even(f'{price} * ({n("unresolved")} - floor(1.0 * {n("unresolved")} * {n("high", "medium", "low")} / greatest(count(*), 1)))', 3)} AS projected_cost FROM ({rows}) a GROUP BY GROUPING SETS ((pattern), ())"""


@operator("A14", "leads")
def discovery_layers(d, price: float = 0.019, since: str = "2022-01-01"):
    """Both layers of discovery with attempts, hits, rate and cost, then the eight sectors with most unresolved companies and how many of those are new."""
    rows = f"SELECT coalesce(sector, 'unknown') AS sector, website IS NOT NULL AS found, {d.has('enrichment_source', d.lit('places_lookup'))} AS asked, coalesce(date_of_creation >= DATE '{since}', false) AS fresh FROM leads"
    row = lambda key, tried, hits, price: f"SELECT 'layer' AS part, '{key}' AS name, {tried} AS attempted, {hits} AS hits, {share(d, hits, tried)} AS pct, {d.even(f'{price} * {tried}', 3)} AS cost FROM ({rows}) r"
    layers = [row("inference", "count(*)", "count_if(found AND NOT asked)", 0), row("places", "count_if(asked OR NOT found)", "count_if(found AND asked)", price)]
    sectors = f"SELECT sector, count(*) AS n, count_if(fresh) AS fresh FROM ({rows}) r WHERE NOT found GROUP BY sector ORDER BY n DESC, sector LIMIT 8"
    return " UNION ALL ".join([*layers, f"SELECT 'sector' AS part, sector AS name, n AS attempted, fresh AS hits, {share(d, 'fresh', 'n')} AS pct, CAST(NULL AS DOUBLE) AS cost FROM ({sectors}) s"])


@operator("A15", "leads")
def batch_stats(d):
    """Status by first source, with all margins."""
    src = f"coalesce({d.at('enrichment_source', '1')}, 'none')"
    return f"SELECT coalesce(status, 'ALL') AS status, coalesce(source, 'ALL') AS source, count(*) AS n, count_if(ai_score IS NOT NULL) AS scored FROM (SELECT coalesce(enrichment_status, 'unknown') AS status, {src} AS source, ai_score FROM leads) t GROUP BY CUBE (status, source)"


@operator("A16", "leads", "places", sides=LINK_SIDES)
def match_tier_counts(d):
    """Leads by the tier of their place, unmatched ones as `no_match`."""
    return f"SELECT coalesce('tier' || CAST(m.tier AS STRING), 'no_match') AS tier, count(*) AS n FROM leads l LEFT JOIN ({link_places.sql(d)}) m ON m.lead_id = l.lead_id GROUP BY 1"


@operator("A17", "usage")
def usage_ledger(d, by_tokens: str = "view", token_price: float = 0.00015, call_price: float = 0.019):
    """Calls, tokens and cost by day and interface; the interface `by_tokens` is paid by thousands of tokens, all others by calls."""
    return f"SELECT api, CAST(ts AS DATE) AS usage_date, sum(calls) AS calls, sum(tokens) AS tokens, {d.even(f'CASE WHEN api = {d.lit(by_tokens)} THEN CAST(sum(tokens) AS DOUBLE) / 1000 * CAST({token_price:f} AS DOUBLE) ELSE CAST(sum(calls) AS DOUBLE) * CAST({call_price:f} AS DOUBLE) END', 6)} AS cost FROM usage GROUP BY api, CAST(ts AS DATE)"


@operator("K1", "leads")
def histogram_by_count(d):
    return "SELECT sector AS key, count(*) AS n FROM leads GROUP BY sector ORDER BY n DESC, key"


@operator("K2", "leads")
def histogram_by_key(d):
    return "SELECT coalesce(enrichment_status, 'unknown') AS key, count(*) AS n FROM leads GROUP BY 1 ORDER BY key"


@operator("K3", "leads")
def patterns_by_hits(d):
    return "SELECT site_pattern AS pattern, count_if(website IS NOT NULL) AS hits FROM leads GROUP BY 1 ORDER BY hits DESC, pattern DESC"


def counters(d) -> dict[str, str]:
    """The counters of a clean-up run, as aggregates over its leads."""
    return {"leads": "count(*)", "flagged": f"count_if({suspect_reason(d)} IS NOT NULL)", "guessed": f"count_if({guess_flag(d)} IS NOT NULL)", "social": f"count_if({social(d, 'website')})", "with_at": f"count_if({has_at('email')})", "blank_names": f"count_if({blank('contact_name')} IS NULL)"}


def _metrics_sql(d) -> str:
    return " UNION ALL ".join(f"SELECT 'cleanup' AS job, '{n}' AS metric, CAST({e} AS DOUBLE) AS value FROM leads" for n, e in counters(d).items())


def observed(rows: DataFrame, path: str, name: str, wanted: dict[str, str]) -> DataFrame:
    """Write rows as Parquet and give what was counted on the way, one row a counter (job, metric, value): no scan but the write's own."""
    seen = Observation(name)
    rows.observe(seen, *(F.expr(e).cast("double").alias(n) for n, e in wanted.items())).write.mode("append").parquet(path)
    return rows.sparkSession.createDataFrame([(name, n, seen.get[n]) for n in wanted], "job string, metric string, value double")


@job("S15", "leads", plain=_metrics_sql)
def run_metrics(leads: DataFrame, path: str | None = None, name: str = "cleanup") -> DataFrame:
    """One row for each counter of a run, taken while the run's leads are written (to `path`, else to a new folder)."""
    return observed(leads, path or folder(leads.sparkSession, "run"), name, counters(SPARK))
