"""Set operations over tables and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import name_key, tokens
from .core import job, operator
from .filters import guess_flag
from .numbering import numbered
from .reports import suspect_reason
from .windows import contacts


@operator("O1", "leads")
def union_categories(d):
    """All leads of one file, then of the other, each with its file as category."""
    return "SELECT lead_id, 'unit8' AS category FROM leads WHERE category = 'unit8' UNION ALL SELECT lead_id, 'office' AS category FROM leads WHERE category = 'office'"


def _union_sql(d) -> str:
    return "SELECT lead_id, part, row_number() OVER (ORDER BY part, ingest_seq) AS seq FROM (SELECT lead_id, ingest_seq, 0 AS part FROM existing UNION ALL SELECT lead_id, ingest_seq, 1 AS part FROM newcomers) t"


@job("O2", "existing", "newcomers", plain=_union_sql)
def union_existing_new(existing: DataFrame, newcomers: DataFrame) -> DataFrame:
    """Known leads, then new ones, each in order, with their place among all from 1."""
    part = lambda rows, n: rows.select("lead_id", "ingest_seq", F.lit(n).alias("part"))
    return numbered(part(existing, 0).unionByName(part(newcomers, 1)), ["part", "ingest_seq"]).select("lead_id", "part", "seq")


@operator("O3", "leads")
def flagged_union(d):
    """Leads flagged for their name or their email, each once."""
    return f"SELECT lead_id FROM leads WHERE {suspect_reason(d)} IS NOT NULL UNION SELECT lead_id FROM leads WHERE {guess_flag(d)} IS NOT NULL"


@operator("O4", "leads")
def merge_contacts(d):
    """Contact lists of all leads of a company, each name once, first spelling wins."""
    return f"SELECT company, name FROM (SELECT {name_key('l.company_name')} AS company, c.name, row_number() OVER (PARTITION BY {name_key('l.company_name')}, lower(c.name) ORDER BY l.ingest_seq, c.pos) AS n FROM leads l JOIN {contacts(d)} c ON c.lead_id = l.lead_id) t WHERE n = 1"


@operator("O5", "rich_pages")
def merge_emails(d):
    """Distinct addresses of each host over all its pages and extractors (markup, mail links, linked data), with how many extractors gave each and its first page."""
    from ..functions.emails import cleaned, found

    mail = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,7}"
    sources = {"markup": found(d, "html"), "link": d.extract_all("html", f'(?i)href="mailto:({mail})', 1), "linked": d.extract_all("html", f'(?i)"email"\\s*:\\s*"(?:mailto:)?({mail})', 1)}
    rows = " UNION ALL ".join(f"SELECT host, page_id, '{name}' AS extractor, {d.explode(of)} AS raw FROM rich_pages" for name, of in sources.items())
    return f"SELECT host, email, count(DISTINCT extractor) AS extractors, min(page_id) AS first_page FROM (SELECT host, page_id, extractor, {cleaned(d, 'lower(raw)')} AS email FROM ({rows}) a) b WHERE email IS NOT NULL GROUP BY host, email"


@operator("O6", "leads")
def split_guesses(d):
    """Team guesses without the primary ones, each once."""
    both = ("list_concat(team_email_guesses, personal_email_guesses)" if d.duck else "concat(team_email_guesses, personal_email_guesses)")
    return f"SELECT lead_id, {d.size(d.distinct('personal_email_guesses'))} AS primary_n, {d.join(d.minus(both, 'personal_email_guesses'), ';')} AS team FROM leads"


@operator("O7", "leads")
def token_sets(d):
    """Tokens that a company's name shares with its contact's."""
    a, b = tokens(d, "company_name", ["the", "and", "of", "ltd"]), tokens(d, "coalesce(contact_name, '')", ["the", "and", "of", "ltd"])
    return f"SELECT lead_id, {d.size(a)} AS company_tokens, {d.size(b)} AS contact_tokens, {d.size(d.intersect(a, b))} AS shared FROM leads"
