"""Landed pages: validity, listings and people."""

from __future__ import annotations

from ..functions import names as N
from ..functions import rules as R
from ..functions.keys import host
from ..operators.core import operator


def page_reason(d) -> str:
    return f"CASE WHEN status IN (403, 429) THEN 'blocked_' || CAST(status AS STRING) WHEN {d.holds('lower(html)', R.BLOCK_WORDS)} THEN 'block_word' WHEN length(html) < 1000 AND contains(lower(html), 'javascript') THEN 'challenge' WHEN length(html) < 2000 THEN 'too_small' END"


@operator("S12", "fetched")
def valid_pages(d):
    """Pages with the reason to reject them, if any."""
    return f"SELECT page_id, url, {page_reason(d)} AS reason FROM fetched"


@operator("S13", "fetched")
def dead_letter(d):
    """Rejected pages as dead-letter rows."""
    return f"SELECT company, url, reason FROM (SELECT {host(d, 'url')} AS company, url, {page_reason(d)} AS reason FROM fetched) t WHERE reason IS NOT NULL"


@operator("S11", "pages")
def listing_blocks(d):
    """First five entries of each listing page: link blocks with name and target, dead and foreign ones dropped."""
    blocks = d.extract_all("html", "(?is)<li[^>]*>(.*?)</li>", 1)
    if d.duck:
        rows = f"SELECT page_id, unnest(range(1, len(b) + 1)) AS pos, unnest(b) AS block FROM (SELECT page_id, {blocks} AS b FROM pages) x"
    else:
        rows = f"SELECT page_id, CAST(p + 1 AS BIGINT) AS pos, block FROM (SELECT page_id, posexplode({blocks}) AS (p, block) FROM pages) x"
    name = f"trim({d.rep('block', '<[^>]*>|\\s+', ' ')})"
    link = d.extract("block", 'href="([^"]*)"', 1)
    return f"""SELECT page_id, place, name, link FROM (SELECT page_id, name, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM (SELECT page_id, pos, {name} AS name, {link} AS link FROM ({rows}) r) s
        WHERE name <> '' AND link <> '' AND NOT {d.match('lower(link)', 'google|youtube|facebook|twitter')} AND NOT {d.match('lower(name)', 'dissolved|liquidation')}) t WHERE place <= 5"""


@operator("S14", "leads", "newcomers", "fallback_leads", "source_runs")
def merge_sources(d, primary: str = "directory"):
    """Sources in their priority, each lead once, by the first source that has it; the fallback only if a run of the primary source failed."""
    rows = f"""SELECT lead_id, 1 AS source_rank FROM leads WHERE category = 'unit8' UNION ALL SELECT lead_id, 2 AS source_rank FROM newcomers
        UNION ALL SELECT lead_id, 3 AS source_rank FROM fallback_leads WHERE (SELECT coalesce(max(CASE WHEN failed THEN 1 ELSE 0 END), 0) FROM source_runs WHERE source = {d.lit(primary)}) = 1"""
    return f"SELECT lead_id, min(source_rank) AS source_rank FROM ({rows}) t GROUP BY lead_id"


@operator("S16", "leads")
def search_grid(d):
    """Every town by every sector met, as search terms. Both dimensions are small lists of distinct values."""
    return "SELECT s.sector || ' in ' || t.town AS term FROM (SELECT DISTINCT split_part(location, ',', 1) AS town FROM leads WHERE location IS NOT NULL) t CROSS JOIN (SELECT DISTINCT sector FROM leads) s"


@operator("T35", "page_text")
def extract_people(d):
    """Names near a role, in headings or in the text, of each page: two capitalised words that pass the contact test, first hit by source."""
    near = d.extract_all("text", "([A-Z][a-z]+ [A-Z][a-z]+)(?:,| -| is)? (?:the |our )?(?:[Dd]irector|[Ff]ounder|[Oo]wner|[Pp]artner|[Tt]herapist)", 1)
    head = d.extract_all(d.rep(d.join(d.extract_all("html", "(?is)<h[1-4][^>]*>(.*?)</h[1-4]>", 1), " | "), "<[^>]*>", ""), "([A-Z][a-z]+ [A-Z][a-z]+)", 1)
    rows = f"SELECT page_id, 1 AS source_rank, {d.explode(near)} AS name FROM page_text UNION ALL SELECT page_id, 2 AS source_rank, {d.explode(head)} AS name FROM page_text"
    return f"SELECT page_id, name, min(source_rank) AS source_rank FROM ({rows}) t WHERE {N.contact_valid(d, 'name')} GROUP BY page_id, name"
