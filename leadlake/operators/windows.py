"""Ranking windows: survivorship, candidate choice, quotas."""

from __future__ import annotations

from ..functions import rules as R
from ..functions.emails import domain_match, free_mail
from ..functions.keys import domain, host, local, name_key, normal, social
from ..functions.names import contact_valid, domain_name, suspect, suspicious, vanity, verdict, without_titles
from .core import operator


#: Places by which a score stands above ingest_seq in one number.
ABOVE = 1 << 56


def best(d, cols: list[str], source: str, part: str, score: str = "0", rows: str | None = None) -> str:
    """One row a part, that of the highest score (0 to 9) and then the least ingest_seq, with the part's first ingest_seq.

    Score and ingest_seq are packed into one number, so that the aggregate keeps
    fixed-width values, hashes, and sends one row a part and task; the rows are
    fetched by their ingest_seq, which must tell them apart and be under 2^56, from
    `rows` if what is fetched needs nothing of the source.
    """
    if d.duck:
        return f"SELECT {', '.join(cols)}, first_seq FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {score} DESC, ingest_seq) AS own_rank, min(ingest_seq) OVER (PARTITION BY {part}) AS first_seq FROM {source} own) w WHERE own_rank = 1"
    first = f"SELECT min((9 - ({score})) * {ABOVE} + ingest_seq) % {ABOVE} AS own_seq, min(ingest_seq) AS first_seq FROM {source} own GROUP BY {part}"
    return f"SELECT {', '.join(f'own.{c}' for c in cols)}, first_seq FROM {rows or source} own JOIN ({first}) w ON own_seq = own.ingest_seq"


@operator("W1", "leads_dup")
def dedupe_keep_enriched(d):
    """One row a name: most of email and contact, then first; at the place of the first."""
    score = "(CASE WHEN email IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN contact_name IS NOT NULL THEN 1 ELSE 0 END)"
    return best(d, ["lead_id", "contact_name", "email"], "leads_dup", name_key("company_name"), score)


def banded(d, rows: str) -> str:
    """Rows with the band (3, 2 or 1) of the points of their data."""
    from .texts import data_points

    return f"(SELECT *, CASE WHEN points >= 7 THEN 3 WHEN points >= 4 THEN 2 ELSE 1 END AS band FROM (SELECT *, {data_points(d)} AS points FROM {rows}) p)"


def name_domain_key(d) -> str:
    return f"{name_key('company_name')} || coalesce('|' || nullif(lower({domain(d, 'website')}), ''), '')"


@operator("W2", "leads_dup")
def dedupe_keep_best_score(d):
    """One row a name and domain: the best band of data points, then first."""
    return best(d, ["lead_id", "ai_score"], banded(d, "leads_dup"), name_domain_key(d), "band", "leads_dup")


@operator("W3", "leads_dup", "existing")
def dedupe_first_wins(d):
    """First row of each name that no known lead has."""
    anti = "ANTI" if d.duck else "LEFT ANTI"
    return best(d, ["lead_id"], f"(SELECT n.* FROM leads_dup n {anti} JOIN (SELECT {name_key('company_name')} AS k FROM existing) e ON {name_key('n.company_name')} = e.k)", name_key("company_name"))


@operator("W4", "officers")
def dedupe_company_number(d):
    """First occurrence of each number, then the filter."""
    return "SELECT company_number, pos FROM (SELECT company_number, pos, role, row_number() OVER (PARTITION BY company_number ORDER BY pos) AS n FROM officers) t WHERE n = 1 AND role <> 'secretary'"


@operator("W5", "officers")
def latest_director(d):
    """Most recently appointed active director of each company."""
    return "SELECT company_number, name, appointed_on FROM (SELECT *, row_number() OVER (PARTITION BY company_number ORDER BY appointed_on DESC, pos) AS n FROM officers WHERE resigned_on IS NULL AND role IN ('director', 'managing-director', 'corporate-director')) t WHERE n = 1"


def contacts(d) -> str:
    if d.duck:
        return "(SELECT lead_id, name, pos FROM (SELECT lead_id, unnest(contact_names) AS name, unnest(range(1, len(contact_names) + 1)) AS pos FROM leads) c)"
    return "(SELECT lead_id, name, CAST(p + 1 AS BIGINT) AS pos FROM (SELECT lead_id, posexplode(contact_names) AS (p, name) FROM leads) c)"


@operator("W6", "leads")
def rank_contacts(d):
    """Contacts of each lead by the tier of the role in their text, titles next, stable."""
    tier = "CASE " + " ".join(f"WHEN {d.holds('lower(name)', words)} THEN {i}" for i, words in enumerate(R.ROLE_TIERS, 1)) + f" WHEN {d.match('lower(name)', '^(dr[ .]|prof[ .]|professor )')} THEN 3 ELSE 99 END"
    return f"SELECT lead_id, name, tier, row_number() OVER (PARTITION BY lead_id ORDER BY tier, pos) AS place FROM (SELECT lead_id, name, pos, {tier} AS tier FROM {contacts(d)} c) t"


@operator("W7", "site_links", "pages")
def rank_site_links(d, most: int = 8):
    """The (eight) best navigation links of each page on its own host, stable; pages with under three are padded with usual paths."""
    link, text = "lower(href)", "lower(anchor)"
    score = f"CASE WHEN {d.holds(link, R.HIGH_LINKS)} OR {d.holds(text, R.HIGH_ANCHORS)} THEN 100 WHEN {d.holds(link, R.JUNK_LINKS)} OR {d.holds(text, R.JUNK_ANCHORS)} THEN 5 WHEN {d.holds(link, R.LOW_LINKS)} OR {d.holds(text, R.LOW_ANCHORS)} THEN 15 WHEN {d.match(link, 'our-|the-')} THEN 20 ELSE 30 END"
    own = f"({d.match('href', '^/[^/]')} OR lower({host(d, 'href')}) = host) AND ({d.holds(link, R.NAV_WORDS)} OR {d.holds(text, R.NAV_WORDS)}) AND NOT {d.match(link, '#|javascript:|mailto:|tel:|[.]pdf|[.]jpg|[.]png')} AND href <> '/'"
    found = f"SELECT page_id, href, min(pos) AS pos, max({score}) AS score FROM site_links WHERE {own} GROUP BY page_id, href"
    path = d.array(R.FALLBACK_PATHS[:10])
    few = f"SELECT p.page_id FROM pages p LEFT JOIN ({found}) f ON f.page_id = p.page_id GROUP BY p.page_id HAVING count(f.href) < 3"
    padded = f"SELECT page_id, {d.at(path, 'i')} AS href, CAST(1000 + i AS BIGINT) AS pos, 0 AS score FROM (SELECT page_id, {d.explode(d.sequence('1', '10'))} AS i FROM ({few}) g) x"
    return f"SELECT page_id, href, score, place FROM (SELECT page_id, href, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS place FROM (SELECT page_id, href, min(pos) AS pos, max(score) AS score FROM (SELECT * FROM ({found}) f UNION ALL SELECT * FROM ({padded}) q) u GROUP BY page_id, href) s) t WHERE place <= {most}"


@operator("W8", "site_emails")
def choose_site_email(d):
    """One personal and one shared address of each lead's site, of those that fit its domain: the site's own host first, then other domains, then free mail; ties by address."""
    own, mail = host(d, "website"), "lower(split_part(email, '@', 2))"
    kind = f"CASE WHEN {d.word(local('email'), R.GENERIC_PREFIXES)} THEN 'generic' ELSE 'personal' END"
    order = f"CASE WHEN {mail} = {own} THEN 0 WHEN NOT {free_mail(d, 'email')} OR kind = 'generic' THEN 1 ELSE 2 END"
    fits = f"SELECT DISTINCT lead_id, website, email, {kind} AS kind FROM site_emails WHERE {domain_match(d, 'email', 'website')} IS NOT NULL"
    return f"SELECT lead_id, kind, email FROM (SELECT lead_id, kind, email, row_number() OVER (PARTITION BY lead_id, kind ORDER BY {order}, lower(email), email) AS n FROM ({fits}) e) t WHERE n = 1"


@operator("W9", "rich_pages")
def choose_first_email(d):
    """First address of each page by source: mail links, attributes, linked data, visible text."""
    part = lambda p: f"nullif(lower({d.extract('html', p, 1)}), '')"
    mail = "[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,7}"
    sources = [part(f'(?i)mailto:({mail})'), part(f'(?i)(?:alt|title|content|data-[a-z]+)="[^"]*?({mail})'), part(f'(?is)ld[+]json.*?"email"\\s*:\\s*"(?:mailto:)?({mail})'), part(f"(?i)>[^<]*?({mail})[^<]*<")]
    rank = " ".join(f"WHEN {s} IS NOT NULL THEN {i}" for i, s in enumerate(sources, 1))
    return f"SELECT page_id, coalesce({', '.join(sources)}) AS email, CASE {rank} END AS source_rank FROM rich_pages"


def promoted_contact(d, company: str) -> tuple[str, str, str]:
    """The contact without titles, the first other contact whose cleaned name is valid, and the name that the company's gives."""
    own = without_titles(d, "contact_name")
    good = d.filter(d.map("contact_names", "w", without_titles(d, "w")), "w", f"{verdict(d, 'w')} = 'valid:'")
    return own, d.at(good, "1"), company


@operator("W10", "leads")
def promote_contact(d):
    """The contact without titles if its verdict is valid, else the first valid of the other contacts, else the name in the company's; what stays invalid is for review."""
    from .texts import company_person

    own, other, company = promoted_contact(d, company_person(d))
    return f"""SELECT lead_id, CASE WHEN ok THEN own ELSE coalesce(other, company, own) END AS contact_name, CASE WHEN ok OR own IS NULL THEN 'own' WHEN other IS NOT NULL THEN 'other' WHEN company IS NOT NULL THEN 'company' ELSE 'own' END AS contact_from,
        NOT ok AND other IS NULL AND company IS NULL AND own IS NOT NULL AS name_review_needed
        FROM (SELECT lead_id, own, other, company, coalesce({verdict(d, 'own')} = 'valid:', false) AS ok FROM (SELECT lead_id, {own} AS own, {other} AS other, {company} AS company FROM (SELECT lead_id, {normal(d, 'contact_name')} AS contact_name, contact_names, company_name FROM leads) a) b) c"""


@operator("W12", "leads")
def sample_head(d, most: int = 20):
    """The first leads without a contact, for a trial run."""
    return f"SELECT lead_id, ingest_seq FROM leads WHERE {normal(d, 'contact_name')} IS NULL ORDER BY ingest_seq LIMIT {most}"


def sector_points(d, text: str) -> list[tuple[str, str]]:
    """(category, sum of its keywords found: 2 for long ones, else 1)."""
    return [(name, " + ".join(f"CASE WHEN contains({text}, {d.lit(k)}) THEN {2 if len(k) > 6 else 1} ELSE 0 END" for k in keys)) for name, keys in R.SECTOR_KEYWORDS.items()]


def sector_of(d, text: str) -> str:
    """The category of most points; ties go to the earlier one; none is General Wellness."""
    points = sector_points(d, text)
    top = "greatest(" + ", ".join(p for _, p in points) + ")"
    return f"CASE WHEN {top} = 0 THEN 'General Wellness' " + " ".join(f"WHEN ({p}) = {top} THEN {d.lit(n)}" for n, p in points) + " END"


@operator("W13", "documents")
def best_sector(d):
    """Sector of each document by keyword points."""
    text = "lower(text)"
    points = sector_points(d, "t")
    cols = ", ".join(f"{p} AS p{i}" for i, (_, p) in enumerate(points))
    names = [f"p{i}" for i in range(len(points))]
    top = "greatest(" + ", ".join(names) + ")"
    pick = " ".join(f"WHEN {c} = {top} THEN {d.lit(n)}" for c, (n, _) in zip(names, points, strict=True))
    return f"SELECT doc_id, CASE WHEN {top} = 0 THEN 'General Wellness' {pick} END AS sector, {top} AS points FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, {text} AS t FROM documents) a) b"


@operator("W14", "site_links")
def cta_links(d, most: int = 3):
    """First (three) distinct call-to-action links of each page on its own host."""
    own = f"({d.holds('lower(anchor)', R.CTA_ANCHORS)} OR {d.holds('lower(href)', R.CTA_LINKS)}) AND NOT {d.match('lower(href)', '^#|^javascript:|mailto:|tel:|[.]pdf|[.]jpg|[.]png')} AND ({d.match('href', '^/')} OR lower({host(d, 'href')}) = host)"
    return f"SELECT page_id, href, place FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM (SELECT page_id, href, min(pos) AS pos FROM site_links WHERE {own} GROUP BY page_id, href) s) t WHERE place <= {most}"


@operator("W15", "site_links")
def contact_links(d, most: int = 6):
    """First (six) distinct links of each page whose target or text names a contact page."""
    return f"SELECT page_id, href, place FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM (SELECT page_id, href, min(pos) AS pos FROM site_links WHERE {d.holds('lower(href || chr(32) || anchor)', R.CONTACT_LINKS)} GROUP BY page_id, href) s) t WHERE place <= {most}"


#: Reasons that tell a name is no person's.
FAKE = ["ui_artifact", "address_fragment", "role_only_name", "concatenated_text", "company_name_echo"]


#: Rank of a role by the words in it; the first that holds.
ROLE_RANKS = [["owner", "founder"], ["director", "managing"], ["principal", "lead"], ["senior", "head"], ["doctor", "dr", "surgeon", "consultant"], ["therapist", "practitioner", "clinician"]]


def _name_of(d, w: str) -> str:
    return f"trim({d.rep(w, '(\\s+[-–|]\\s|,|\\s*[(]).*$')})"


def _rank_of(d, w: str) -> str:
    """1 to 6 by the role behind the name, 5 for a doctor's title, else 7."""
    role = f"lower(substr({w}, length({_name_of(d, w)}) + 1))"
    ranks = [d.holds(role, words) for words in ROLE_RANKS]
    ranks[4] = f"({ranks[4]} OR {d.match(f'lower({w})', '^dr[ .]')})"
    return "CASE " + " ".join(f"WHEN {r} THEN {i}" for i, r in enumerate(ranks, 1)) + " ELSE 7 END"


@operator("U2", "leads")
def resolve_contact(d, main: str | None = None):
    """Doubtful names: the best valid candidate stands in, by the role behind its name in six ranks, then in order; without one, a definite fake that no trusted source gave is cleared, all others stay.

    The other contacts are the site's team.  `main` names a column with the page's
    main contact, which comes before them and must not look made up either.  Gives
    all valid candidates in their order too.
    """
    site = host(d, "website")
    name = _name_of(d, "w")
    ok = f"({contact_valid(d, name)} AND NOT {domain_name(d, name, site)} AND NOT {vanity(d, name, 'company_name')})"
    one = f"[{main}]" if d.duck else f"array({main})"
    first = f"CASE WHEN {suspicious(d, _name_of(d, main))} THEN contact_names ELSE {one} || contact_names END" if main else "contact_names"
    good = d.filter("offered", "w", ok)
    ordered = " || ".join(d.map(d.filter("good", "w", f"({_rank_of(d, 'w')}) = {i}"), "w", name) for i in range(1, 8))
    reason = suspect(d, "contact_name", "company_name", "refinement_notes", "confidence_score")
    return f"""SELECT lead_id, reason, action, CASE action WHEN 'replaced' THEN best WHEN 'cleared' THEN NULL ELSE contact_name END AS contact_name, CASE WHEN action = 'replaced' THEN {d.join('ranked', '; ')} END AS candidates FROM (
        SELECT lead_id, reason, contact_name, best, ranked, CASE WHEN reason IS NULL THEN 'kept' WHEN best IS NOT NULL THEN 'replaced' WHEN {d.word('reason', FAKE)} THEN CASE WHEN coalesce({d.word('contact_source', R.SOURCES_OF_TRUST)}, false) THEN 'kept_verified' ELSE 'cleared' END ELSE 'kept_no_replacement' END AS action
        FROM (SELECT lead_id, contact_name, contact_source, reason, ranked, {d.at('ranked', '1')} AS best FROM (SELECT lead_id, contact_name, contact_source, reason, {ordered} AS ranked FROM (
        SELECT lead_id, contact_name, contact_source, {reason} AS reason, {good} AS good FROM (SELECT *, {first} AS offered FROM leads) z) y) a) b) c"""


@operator("J10", "leads", "page_text")
def accept_domain(d):
    """First candidate site of each lead, its own one first, then in pattern order, whose landed page validates."""
    from .texts import candidate_rows, page_signs, validation

    own = f"SELECT lead_id, 0 AS pattern, 0 AS place, website AS url, website AS landed FROM leads WHERE website IS NOT NULL AND NOT {social(d, 'website')}"
    slugs = f"SELECT lead_id, pattern, place, url, {host(d, 'url')} AS landed FROM ({candidate_rows(d)}) r"
    # one page stands for a candidate: the lead's own, or the first of the host
    first = "SELECT url AS landed, min(page_id) AS page_id FROM page_text GROUP BY url UNION ALL SELECT host AS landed, min(page_id) AS page_id FROM page_text GROUP BY host"
    return f"""SELECT lead_id, pattern, url, confidence FROM (SELECT lead_id, pattern, url, confidence, row_number() OVER (PARTITION BY lead_id ORDER BY place, page_id) AS n FROM (
        SELECT c.lead_id, c.pattern, c.place, c.url, p.page_id, {validation(d, 'l.company_name', 'c.pattern')} AS confidence
        FROM ({own} UNION ALL {slugs}) c JOIN ({first}) f ON f.landed = c.landed JOIN leads l ON l.lead_id = c.lead_id JOIN ({page_signs(d)}) p ON p.page_id = f.page_id) v WHERE confidence <> 'reject') t WHERE n = 1"""

