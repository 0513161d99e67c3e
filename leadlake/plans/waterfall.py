"""Enrichment as a staged waterfall: each source is asked only about the leads that the sources before left incomplete.

Every stage takes the rows that are still incomplete, adds what its source knows,
writes them, and passes on those that still lack a contact or an address.  So a
source is joined with no more rows than need it, and a lead ends at the first stage
that completes it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import emails as E
from ..functions import names as N
from ..functions.dialect import SPARK, Dialect
from ..functions.keys import facebook, host, normal, social
from ..operators import joins
from ..operators.core import job, query
from ..sources.store import written

STAGES = ["own", "excluded", "website", "registry", "verdict", "left"]
ROW = "lead_id, company_name, website, site, real_site, contact, contact_from, email, guessed, principal"
#: A name before its role, in a page's text.
NEAR = "([A-Z][a-z]+ [A-Z][a-z]+)(?:,| -| is)? (?:the |our )?(?:[Dd]irector|[Ff]ounder|[Oo]wner|[Pp]artner|[Tt]herapist)"


def begin(d: Dialect) -> str:
    """All leads with what they have, and whether they end before any source is asked."""
    full = f"contact_name IS NOT NULL AND email IS NOT NULL AND {d.size('contact_names')} > 0 AND (generic_email IS NOT NULL OR {d.size('personal_email_guesses')} > 0)"
    page = d.some("enrichment_source", "x", facebook(d, "x"))
    real = f"coalesce(website <> '' AND NOT {social(d, 'website')}, false)"
    return f"""SELECT lead_id, company_name, website, CASE WHEN {real} THEN {host(d, 'website')} END AS site, {real} AS real_site, {normal(d, 'contact_name')} AS contact, CASE WHEN {normal(d, 'contact_name')} IS NOT NULL THEN 'own' END AS contact_from,
        {normal(d, 'email')} AS email, coalesce(email_guessed, false) AS guessed, {normal(d, 'principal_name')} AS principal, CASE WHEN {full} THEN 'own' WHEN coalesce(website, '') = '' AND NOT {page} THEN 'excluded' END AS stage FROM leads"""


def _with_contact(d: Dialect, rows: str, name: str, source: str) -> str:
    """Rows that take a found name (and the address guessed from it) where they have none."""
    guess = d.at(E.guesses(d, "found_name", "site"), "1")
    return f"""SELECT lead_id, company_name, website, site, real_site, coalesce(contact, found_name) AS contact, CASE WHEN contact IS NULL AND found_name IS NOT NULL THEN '{source}' ELSE contact_from END AS contact_from,
        coalesce(email, found_email, CASE WHEN contact IS NULL THEN {guess} END) AS email, CASE WHEN email IS NULL AND found_email IS NOT NULL THEN false WHEN email IS NULL AND contact IS NULL AND {guess} IS NOT NULL THEN true ELSE guessed END AS guessed, principal
        FROM (SELECT *, {name} AS found_name FROM ({rows}) a) b"""


def from_website(d: Dialect) -> str:
    """The first address of the landed page, and its first name by a role that is neither the site's nor the company's."""
    page = f"SELECT url, {d.at('mails', '1')} AS found_email, names FROM (SELECT url, {E.found(d, 'text')} AS mails, {d.extract_all('text', NEAR, 1)} AS names FROM (SELECT url, text FROM page_text WHERE url IN (SELECT website FROM waiting WHERE real_site)) p) m"
    ok = d.filter("names", "w", f"{N.contact_valid(d, 'w')} AND NOT {N.domain_name(d, 'w', 'site')} AND NOT {N.vanity(d, 'w', 'company_name')}")
    return _with_contact(d, f"SELECT w.*, p.found_email, p.names FROM waiting w LEFT JOIN ({page}) p ON w.real_site AND p.url = w.website", d.at(ok, "1"), "website")


def from_registry(d: Dialect) -> str:
    """The known principal, else the registry's, whose name stands in for a missing contact."""
    asked = f"SELECT lead_id AS own_id, {N.person_format(d, 'principal')} AS principal FROM ({joins.principal_for_lead.sql(d)}) j".replace("FROM leads l JOIN", "FROM waiting l JOIN")
    named = f"CASE WHEN {N.contact_valid(d, 'known')} THEN known END"
    rows = f"SELECT w.lead_id, w.company_name, w.website, w.site, w.real_site, w.contact, w.contact_from, w.email, w.guessed, coalesce(w.principal, {named}) AS principal, CAST(NULL AS STRING) AS found_email FROM (SELECT w.*, a.principal AS known FROM waiting w LEFT JOIN ({asked}) a ON a.own_id = w.lead_id) w"
    return _with_contact(d, rows, "principal", "registry")


def from_verdicts(d: Dialect) -> str:
    """The name in the first answer that found one."""
    asked = f"SELECT lead_id AS own_id, min_by(answer, answered_at) AS answer FROM verdicts WHERE {d.starts('upper(answer)', d.lit('FOUND:'))} GROUP BY lead_id"
    name = "trim(split_part(substr(answer, 7), '|', 1))"
    ok = f"CASE WHEN {N.contact_valid(d, name)} AND NOT {N.vanity(d, name, 'company_name')} THEN {name} END"
    return _with_contact(d, f"SELECT w.*, a.answer, CAST(NULL AS STRING) AS found_email FROM waiting w LEFT JOIN ({asked}) a ON a.own_id = w.lead_id", ok, "verdict")


SOURCES: dict[str, Callable[[Dialect], str]] = {"website": from_website, "registry": from_registry, "verdict": from_verdicts}
OPEN = "contact IS NULL OR email IS NULL"


def _plain(d: Dialect) -> str:
    """All stages as one statement of nested tables, for comparison."""
    parts, last = [f"b0 AS ({begin(d)})", f"waiting0 AS (SELECT {ROW} FROM b0 WHERE stage IS NULL)"], "waiting0"
    ended = ["SELECT lead_id, stage, contact, contact_from, email, guessed, principal FROM b0 WHERE stage IS NOT NULL"]
    for i, (name, build) in enumerate(SOURCES.items(), 1):
        parts += [f"s{i} AS (SELECT * FROM (WITH waiting AS (SELECT * FROM {last}) {build(d)}) x)", f"waiting{i} AS (SELECT * FROM s{i} WHERE {OPEN})"]
        ended.append(f"SELECT lead_id, '{name}' AS stage, contact, contact_from, email, guessed, principal FROM s{i} WHERE NOT ({OPEN})")
        last = f"waiting{i}"
    ended.append(f"SELECT lead_id, 'left' AS stage, contact, contact_from, email, guessed, principal FROM {last}")
    return f"SELECT * FROM (WITH {', '.join(parts)} {' UNION ALL '.join(ended)}) q"


@job("P4S", "leads", "page_text", "officers", "controllers", "verdicts", plain=_plain)
def waterfall_stages(leads: DataFrame, page_text: DataFrame, officers: DataFrame, controllers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Where each lead ends, with its contact, address and where they came from.

    Complete leads end at `own`, those without any web presence at `excluded`; then
    the site's page, the registry and landed verdicts are asked in turn, each about
    what is still incomplete.  What no source completes ends at `left`.
    """
    all_ = written(query(begin(SPARK), leads=leads), "waterfall")
    out = ["lead_id", "stage", "contact", "contact_from", "email", "guessed", "principal"]
    ended, waiting = [all_.where("stage IS NOT NULL").select(*out)], all_.where("stage IS NULL").drop("stage")
    known = {"page_text": page_text, "officers": officers, "controllers": controllers, "verdicts": verdicts}
    for name, build in SOURCES.items():
        asked = written(query(build(SPARK), waiting=waiting, **known), f"waterfall-{name}")
        ended.append(asked.where(f"NOT ({OPEN})").withColumn("stage", F.lit(name)).select(*out))
        waiting = asked.where(OPEN)
    return reduce(DataFrame.unionByName, [*ended, waiting.withColumn("stage", F.lit("left")).select(*out)])


def sizes(found: DataFrame) -> DataFrame:
    """Leads by the stage at which they end."""
    return found.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
