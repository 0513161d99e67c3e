"""Views that shape the star-schema tables as contact tables, in SQL for either engine."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..functions.keys import host
from ..functions.rules import BUSINESS_WORDS, FIRST_NAMES, SEARCH_TOWNS

FIRST = ["Emma", "John", "Sarah", "Zlxqr", "Helen", "Mark", "Ed", "Priya", "Tom", "Wlada", "Ann-Marie"]
LAST = ["Jones", "Brown", "O'Brien", "Ng", "Mcstrzk", "Patel", "Clinic", "Smith-Hall", "Taylor", "Wright", "Xu", "Bbbone", "Evans"]
COMPANY = ["Acme Therapy", "Woking Dental Practice", "Emma Jones Counselling", "Harbour Holdings", "Surrey Law", "Green Digital Agency", "Hill Physio & Co", "Sarah Brown - Osteopath", "Farnham Yoga Studio"]
SUFFIX = ["Ltd", "Limited", "LLP", "Group", "Clinic"]
NOTES = ["possible_placeholder_name", "email_rescrape_done", "single_name_only", "geo:old", "email_replaced_from_website:a->b", "rescrape_v4", "checked", "no_named_individual_found"]


def pick(d: Dialect, items, index: str) -> str:
    return d.at(d.array(items), f"({index}) + 1")


def slot(k: str, step: int, n: int) -> str:
    return f"CAST(floor({k} / {step}) AS BIGINT) % {n}"


def leads(d: Dialect) -> str:
    """One lead a customer; gaps and defects by the key's remainders."""
    k = "k"
    name = f"{pick(d, FIRST, slot(k, 3, len(FIRST)))} || ' ' || {pick(d, LAST, slot(k, 5, len(LAST)))}"
    site = host(d, "url")
    note = lambda i: pick(d, NOTES, f"(k + {i}) % {len(NOTES)}")
    arr = lambda *x: ("[" if d.duck else "array(") + ", ".join(x) + ("]" if d.duck else ")")
    return f"""SELECT CAST(k AS STRING) AS lead_id, k AS ingest_seq, company_name, website, c_mktsegment AS sector,
        CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN 'Book Now' WHEN k % 9 = 2 THEN 'Dr ' || {name} WHEN k % 9 = 3 THEN company_name WHEN k % 31 = 4 THEN 'nan' ELSE {name} END AS contact_name,
        CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN 'info@' || {site} WHEN k % 8 = 2 THEN 'account.suspended@' || {site} WHEN k % 8 = 3 THEN 'someone.else@gmail.com'
             ELSE lower(replace({name}, ' ', '.')) || '@' || {site} END AS email,
        CASE WHEN k % 7 = 0 THEN NULL ELSE {pick(d, SEARCH_TOWNS, f'k % {len(SEARCH_TOWNS)}')} || ', GU' || CAST(1 + k % 30 AS STRING) || ' ' || CAST(k % 9 AS STRING) || 'AB' END AS location,
        CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(1 + k % 10 AS INT) END AS ai_score,
        CASE WHEN k % 2 = 0 THEN 'unit8' ELSE 'office' END AS category,
        CASE k % 4 WHEN 1 THEN true WHEN 2 THEN false END AS email_guessed,
        CASE k % 5 WHEN 1 THEN true WHEN 3 THEN false END AS contact_verified,
        CASE WHEN k % 3 = 0 THEN 'hello@' || {site} END AS generic_email,
        CASE WHEN k % 4 = 0 THEN {arr(name, "'Jane Doe'", "'Laura Evans Director'")} ELSE {d.text_array()} END AS contact_names,
        CASE WHEN k % 5 = 0 THEN {arr(f"lower(replace({name}, ' ', '.')) || '@' || {site}", f"'x@' || {site}")} ELSE {d.text_array()} END AS personal_email_guesses,
        CASE WHEN k % 10 = 0 THEN {arr(f"'team@' || {site}")} ELSE {d.text_array()} END AS team_email_guesses,
        CASE WHEN k % 6 = 1 THEN {name} WHEN k % 6 = 2 THEN 'Ruth Evans' END AS principal_name,
        CASE WHEN k % 12 = 1 THEN 'p.' || CAST(k AS STRING) || '@' || {site} END AS principal_email_guess,
        CASE WHEN k % 16 = 5 THEN 'c.' || CAST(k AS STRING) || '@' || {site} END AS contact_email,
        CASE k % 6 WHEN 0 THEN 'guessed' WHEN 1 THEN 'both' WHEN 2 THEN 'personal' WHEN 3 THEN 'generic' END AS email_type,
        CASE k % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'facebook' WHEN 2 THEN 'no' END AS website_verified,
        CASE WHEN k % 19 <> 5 THEN CAST(k % 4 AS INT) END AS enrichment_attempts,
        CASE WHEN k % 5 = 4 THEN NULL ELSE CAST(1 + k % 5 AS DOUBLE) END AS confidence_score,
        CASE WHEN k % 3 = 2 THEN {arr(note(0), note(3))} ELSE {d.text_array()} END AS refinement_notes,
        CASE WHEN k % 6 = 3 THEN {arr("'registry'", "'places_lookup'")} WHEN k % 6 = 4 THEN {arr("'website_team_heading'")} ELSE {d.text_array()} END AS enrichment_source,
        CASE k % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'missing_email' WHEN 2 THEN 'missing_name' END AS enrichment_status,
        CASE k % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'review' WHEN 2 THEN 'exclude' END AS geo_relevance,
        CASE k % 9 WHEN 0 THEN 'larger' WHEN 4 THEN 'small_new' END AS size_signal,
        CASE WHEN k % 7 = 3 THEN '01483 ' || lpad(CAST(k % 1000000 AS STRING), 6, '0') END AS phone,
        CASE WHEN k % 5 = 2 THEN 'pl' || CAST(k % 40 AS STRING) END AS place_id,
        CASE WHEN k % 17 <> 3 THEN k % 13 = 6 END AS missing_name_final,
        CASE WHEN k % 8 = 5 THEN 'https://linkedin.com/in/p' || CAST(k AS STRING) END AS linkedin,
        CASE WHEN k % 9 = 4 THEN CAST(1 + k % 50 AS STRING) END AS employee_count,
        CASE k % 7 WHEN 1 THEN 'website_verified' WHEN 2 THEN 'companies_house' WHEN 4 THEN 'website' END AS contact_source,
        CASE k % 11 WHEN 4 THEN 'dissolved' WHEN 9 THEN 'liquidation' ELSE 'active' END AS company_status,
        CAST(k % 7 + 1 AS INT) AS site_pattern,
        {f"DATE '2016-01-01' + CAST(k * 7 % 3000 AS INT)" if d.duck else "date_add(DATE '2016-01-01', CAST(k * 7 % 3000 AS INT))"} AS date_of_creation,
        CASE WHEN k % 11 <> 2 THEN {f"DATE '2024-06-01' + CAST(k % 30 AS INT)" if d.duck else "date_add(DATE '2024-06-01', CAST(k % 30 AS INT))"} END AS last_enriched_date
      FROM (SELECT c.c_custkey AS k, c.c_mktsegment, p.url, n.n_name,
          {pick(d, COMPANY, f'c.c_custkey % {len(COMPANY)}')} || ' ' || {pick(d, SUFFIX, slot('c.c_custkey', 9, len(SUFFIX)))} || CASE WHEN c.c_custkey % 3 = 0 THEN '' ELSE ' ' || CAST(c.c_custkey AS STRING) END AS company_name,
          CASE WHEN c.c_custkey % 10 = 3 THEN NULL WHEN c.c_custkey % 40 = 21 THEN 'https://www.instagram.com/p' || CAST(c.c_custkey AS STRING) WHEN c.c_custkey % 10 = 1 THEN 'https://www.facebook.com/p' || CAST(c.c_custkey AS STRING) ELSE p.url END AS website
        FROM (SELECT *, c_custkey % (SELECT count(*) FROM pages) AS page_no FROM customer) c
        JOIN pages p ON p.page_id = c.page_no JOIN nation n ON n.n_nationkey = c.c_nationkey) b"""


DUP = "location, contact_name, email, place_id, ai_score, confidence_score, website_verified, contact_email, generic_email, principal_name, personal_email_guesses, phone"


def leads_dup(d: Dialect) -> str:
    """leads with later copies of a third of them: other case and spaces, some without email."""
    late = DUP.replace("contact_name", "coalesce(contact_name, 'Late Name')", 1).replace(" email,", " CASE WHEN ingest_seq % 2 = 0 THEN email END,", 1)
    return f"""SELECT lead_id, ingest_seq, company_name, website, {DUP} FROM leads
      UNION ALL SELECT lead_id || 'x', ingest_seq + 100000000, '  ' || upper(company_name), website, {late} FROM leads WHERE ingest_seq % 3 = 1"""


def existing(d: Dialect) -> str:
    return "SELECT * FROM leads WHERE ingest_seq % 5 = 0"


def first_names(d: Dialect) -> str:
    return f"SELECT {d.explode(d.array(FIRST_NAMES))} AS word"


def business_words(d: Dialect) -> str:
    return f"SELECT {d.explode(d.array(BUSINESS_WORDS))} AS word"


def newcomers(d: Dialect) -> str:
    return "SELECT * FROM leads WHERE ingest_seq % 5 <> 0"


def fallback_leads(d: Dialect) -> str:
    return "SELECT * FROM leads WHERE ingest_seq % 5 = 0"


def source_runs(d: Dialect) -> str:
    """Runs of the sources of leads, and whether each failed."""
    return "SELECT CASE event_type WHEN 'view' THEN 'directory' WHEN 'click' THEN 'search' ELSE 'places' END AS source, ts AS ended_at, event_type = 'view' AND value > 99 AS failed FROM events"


def requests(d: Dialect) -> str:
    """Calls that leads without a site wait for, with their layer and price in millionths of a dollar."""
    return "SELECT lead_id, ingest_seq, CASE ingest_seq % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'model' ELSE 'places' END AS layer, CASE ingest_seq % 4 WHEN 0 THEN 0 WHEN 1 THEN 225 + ingest_seq % 100 ELSE 19000 END AS micros FROM leads WHERE website IS NULL OR ingest_seq % 6 = 0"


def later(d: Dialect) -> str:
    """A later run over the known leads: some contacts lost or replaced, some addresses replaced, other lists and details found."""
    found = d.slice(d.array(["Ann Lee", "Jane Doe", "Bo Li"]), "1", "ingest_seq % 4")
    guessed = d.slice(d.array(["a@x.org", "b@x.org", "c@x.org"]), "1", "CAST(floor(ingest_seq / 5) AS BIGINT) % 4")
    return f"""SELECT lead_id, ingest_seq, company_name, CASE WHEN ingest_seq % 4 = 0 THEN NULL WHEN ingest_seq % 4 = 1 THEN 'New Name' ELSE contact_name END AS contact_name,
        CASE WHEN ingest_seq % 3 = 0 THEN 'new@x.org' ELSE email END AS email,
        {found} AS contact_names, {guessed} AS personal_email_guesses, CASE WHEN ingest_seq % 4 < 2 THEN '01999 ' || CAST(ingest_seq AS STRING) END AS phone, CASE WHEN ingest_seq % 3 = 1 THEN 'later@' || 'x.org' END AS generic_email,
        CASE WHEN ingest_seq % 7 = 2 THEN 'https://linkedin.com/in/later' END AS linkedin, CASE WHEN ingest_seq % 4 = 3 THEN '12' END AS employee_count, 'LATER' AS sector FROM existing"""


def found_emails(d: Dialect) -> str:
    """An address found later on the sites of half of the leads."""
    return f"SELECT lead_id, CASE WHEN ingest_seq % 4 = 0 THEN 'new.person@' ELSE 'info@' END || {host(d, 'website')} AS found FROM leads WHERE ingest_seq % 4 < 2 AND website IS NOT NULL"


def site_emails(d: Dialect) -> str:
    """Every address that a lead's site could have shown."""
    arrays = f"SELECT lead_id, website, {d.explode('personal_email_guesses')} AS email FROM leads UNION ALL SELECT lead_id, website, {d.explode('team_email_guesses')} AS email FROM leads"
    return " UNION ALL ".join([*(f"SELECT lead_id, website, {c} AS email FROM leads WHERE {c} IS NOT NULL" for c in ("email", "generic_email", "principal_email_guess", "contact_email")), arrays])


def verdicts(d: Dialect) -> str:
    """Answers of a model about leads, by time; the lead is told by its number."""
    answer = "CASE event_type WHEN 'view' THEN 'CONFIRMED' WHEN 'error' THEN 'REJECTED' WHEN 'click' THEN 'UNCERTAIN' WHEN 'signup' THEN 'FOUND: Laura Evans | Director' WHEN 'purchase' THEN CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'FOUND: Clinic Room | Owner' WHEN 1 THEN 'FALSE - a product' ELSE 'REAL' END ELSE '{\"score\": 8, \"reason\": \"near\", \"sector\": \"Yoga\", \"tag\": \"studio\"}' END"
    return f"SELECT CAST(CAST(floor(value) AS BIGINT) AS STRING) AS lead_id, ts AS answered_at, {answer} AS answer FROM events"


def companies(d: Dialect) -> str:
    """Companies of three sources with their sources' words for status."""
    return """SELECT o_orderkey AS company_key, CASE o_orderpriority WHEN '1-URGENT' THEN 'registry' WHEN '2-HIGH' THEN 'search' ELSE 'places' END AS source,
        CASE WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderpriority = '1-URGENT' THEN CASE o_orderstatus WHEN 'F' THEN 'dissolved' ELSE 'active' END
             WHEN o_orderpriority = '2-HIGH' THEN CASE o_orderstatus WHEN 'F' THEN 'dissolved' ELSE 'liquidation' END ELSE CASE o_orderstatus WHEN 'P' THEN 'CLOSED_PERMANENTLY' ELSE 'OPERATIONAL' END END AS status FROM orders"""


def company_codes(d: Dialect) -> str:
    """Industry codes of each company, in order."""
    return f"SELECT CAST(o_custkey AS STRING) AS company_number, o_orderkey AS pos, {pick(d, ['70229', '12345', '62020', '69102', '99999', '71111', '85600'], 'o_orderkey % 7')} AS code FROM orders"


def controllers(d: Dialect) -> str:
    """Persons with control of a company; some have ceased to be."""
    return """SELECT CAST(o_custkey AS STRING) AS company_number, o_orderkey AS pos, 'HOLDER-' || CAST(o_custkey % 89 AS STRING) || ', Ann' AS name,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS ceased_on FROM orders WHERE o_orderkey % 5 = 2"""


def fetched(d: Dialect) -> str:
    """Landed pages with the status of their fetch."""
    return "SELECT page_id, url, html, CASE WHEN page_id % 41 = 7 THEN 403 WHEN page_id % 43 = 9 THEN 429 ELSE 200 END AS status FROM pages"


def officers(d: Dialect) -> str:
    return """SELECT CAST(o_custkey AS STRING) AS company_number, o_orderkey AS pos,
        CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE 'SMITH-' || CAST(o_custkey % 97 AS STRING) || ', John ' || o_orderpriority END AS name,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'director' WHEN '2-HIGH' THEN 'managing-director' WHEN '3-MEDIUM' THEN 'corporate-director' ELSE 'secretary' END AS role,
        CAST(o_orderdate AS DATE) AS appointed_on, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS resigned_on FROM orders"""


def places(d: Dialect) -> str:
    return f"""SELECT 'pl' || CAST(p_partkey AS STRING) AS place_id, p_partkey AS pos, {pick(d, COMPANY, f'p_partkey % {len(COMPANY)}')} || ' ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_brand ELSE ' ' || CAST(p_partkey AS STRING) END AS display_name,
        {d.split("lower(p_type) || CASE p_partkey % 6 WHEN 0 THEN ' barber_shop' WHEN 1 THEN ' spa health' WHEN 2 THEN ' lawyer' WHEN 3 THEN ' gym' WHEN 4 THEN ' restaurant' ELSE ' doctor' END", ' ')} AS types,
        CASE WHEN p_size % 5 = 0 THEN 'CLOSED_PERMANENTLY' WHEN p_size % 5 < 4 THEN 'OPERATIONAL' END AS status,
        CAST(p_size % 50 AS DOUBLE) / 10 AS rating, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS reviews,
        CASE WHEN p_partkey % 3 < 2 THEN 'https://place' || CAST(p_partkey AS STRING) || '.org' END AS website, CASE WHEN p_partkey % 5 < 3 THEN '01000 ' || CAST(p_partkey AS STRING) END AS phone,
        {pick(d, SEARCH_TOWNS, f'p_partkey % {len(SEARCH_TOWNS)}')} AS town,
        {pick(d, SEARCH_TOWNS, f'p_partkey % {len(SEARCH_TOWNS)}')} || CASE WHEN p_partkey % 4 = 0 THEN ', GU7 2AB' ELSE '' END AS address FROM part"""


def usage(d: Dialect) -> str:
    return "SELECT event_type AS api, ts, CAST(1 AS BIGINT) AS calls, CAST(floor(value) AS BIGINT) AS tokens FROM events"


def page_text(d: Dialect) -> str:
    """Visible text of each page (every third with a line that names services and a person): scripts, styles and comments dropped, tags as blanks, common entities decoded."""
    x = "html"
    for tag in ("script", "style", "noscript"):
        x = d.rep(x, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    x = d.rep(d.rep(x, "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {d.lit(a)}, {d.lit(b)})"
    return f"""SELECT page_id, url, {host(d, 'url')} AS host, html, trim({d.squeeze(x)}) || CASE page_id % 3 WHEN 0 THEN ' Therapy, dental and yoga in Surrey. Meet the team: Helen Jones, Director.' ELSE '' END AS text,
        trim({d.rep(d.extract('html', '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ')}) AS title,
        trim({d.rep(d.extract('html', '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>|\\s+', ' ')}) AS h1 FROM pages"""


def rich_pages(d: Dialect) -> str:
    """Pages with a protected address, a mail link or linked data added by remainder of the page's number."""
    mail = f"'office@' || {host(d, 'url')}"
    key = "CAST(page_id % 200 + 11 AS INT)"
    code = d.to_hex(key) + " || " + d.join(d.map(d.sequence("1", f"CAST(length({mail}) AS INT)"), "i", d.to_hex(d.xor(f"ascii(substr({mail}, i, 1))", key))), "")
    return f"""SELECT page_id, url, {host(d, 'url')} AS host, html || CASE page_id % 4 WHEN 0 THEN '<a class="x" data-cfemail="' || {code} || '">[hidden]</a>' WHEN 1 THEN '<a href="mailto:' || {mail} || '?subject=x">write</a>'
        WHEN 2 THEN '<script type="application/ld+json">{{"@type":"Organization","contactPoint":{{"email":"' || {mail} || '"}}}}</script>' ELSE '<img alt="mail ' || {mail} || '">' END AS html FROM pages"""


def _with(d: Dialect, cases: list[str], by: str = "page_id") -> str:
    """The pages' markup with one of the endings, by remainder, before the body's end or at the end."""
    return f"html || CASE {by} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def linked_pages(d: Dialect) -> str:
    """Pages with linked data of several shapes, some of it broken, and addresses in footers and contact blocks."""
    mail = f"'m' || CAST(page_id AS STRING) || '@' || {host(d, 'url')}"
    data = lambda body: "'<script type=\"application/ld+json\">" + body.replace("@@", f"' || {mail} || '") + "</script>'"
    cases = [data('{"email":"mailto:@@"}'), data('{"@graph":[{"@type":"x"},{"contactPoint":[{"email":"@@"},{"email":"a.@@"}]}]}'), data('[{"contactPoint":"@@"}, 7]'), data('{"email":"@@"'), data('{"a":{"b":[[{"c":{"email":"@@"}}]]},"email":["@@"]}'), f"'<footer><p>write to ' || {mail} || '</p></footer>'", f"'<div id=\"contact-us\"><a href=\"mailto:' || {mail} || '?subject=x\">mail</a>'"]
    return f"SELECT page_id, {_with(d, cases)} AS html FROM pages"


def person_pages(d: Dialect) -> str:
    """Pages that show people in several ways, by remainder."""
    name = f"{pick(d, FIRST, slot('page_id', 3, len(FIRST)))} || ' ' || {pick(d, LAST, slot('page_id', 5, len(LAST)))}"
    cases = [
        f"'<div class=\"team\"><h3>' || {name} || '</h3><p>Director</p></div>'",
        f"'<h2>' || {name} || '</h2><p>lead therapist</p><h2>Laura Evans</h2><p>Owner</p><h2>Helen Taylor</h2><p>Osteopath</p>'",
        f"'<meta name=\"author\" content=\"' || {name} || '\">'",
        f"'<script type=\"application/ld+json\">{{\"founder\":{{\"name\":\"' || {name} || '\",\"jobTitle\":\"Owner\"}}}}</script>'",
        f"'<p>Our clinic was founded by ' || {name} || ' in May.</p><img alt=\"' || {name} || '\">'",
    ]
    return f"SELECT page_id, {_with(d, cases)} AS html FROM pages"


def listing_pages(d: Dialect) -> str:
    """Pages of three kinds of listing, with entries made of the pages' links."""
    item = "replace(url, '/', ' ')"
    entry = [
        f"'<li class=\"type-company\"><a href=\"/c/' || CAST(page_id AS STRING) || '\">' || {item} || '</a><p>1 High St</p><span class=\"meta\">' || CASE WHEN page_id % 7 = 0 THEN 'Dissolved' ELSE 'Active' END || '</span></li>'",
        f"'<div class=\"businessCapsule\"><h2>' || {item} || '</h2><span class=\"address\">2 Low Rd</span><a class=\"businessCapsule--callToAction\" href=\"' || url || '\">go</a><p class=\"businessCapsule--description\">text</p></div>'",
        f"'<div class=\"g\"><a href=\"' || url || '\"><h3>' || {item} || ' - Home</h3></a><div class=\"VwiC3b\">snippet</div></div>'",
    ]
    kind = "CASE page_id % 3 WHEN 0 THEN 'registry' WHEN 1 THEN 'directory' ELSE 'search' END"
    return f"SELECT page_id, {kind} AS kind, {_with(d, entry)} AS html FROM pages"


def site_links(d: Dialect) -> str:
    """Anchors of each page in order; some targets are renamed to navigation pages by their place."""
    own = lambda href, pos: f"CASE ({pos}) % 4 WHEN 1 THEN '/about-' || replace({href}, '/', '') WHEN 2 THEN '/contact' ELSE {href} END"
    hrefs = d.extract_all("html", '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>', 1)
    texts = d.extract_all("html", '(?is)<a\\s[^>]*href="[^"]*"[^>]*>(.*?)</a>', 1)
    if d.duck:
        return f"""SELECT page_id, host, pos, {own('list_extract(h, pos)', 'pos')} AS href, trim({d.rep("coalesce(list_extract(t, pos), '')", '<[^>]*>|\\s+', ' ')}) AS anchor
            FROM (SELECT page_id, {host(d, 'url')} AS host, h, t, unnest(range(1, len(h) + 1)) AS pos FROM (SELECT page_id, url, {hrefs} AS h, {texts} AS t FROM pages) a) b"""
    return f"""SELECT page_id, host, CAST(i + 1 AS BIGINT) AS pos, {own('href', 'i + 1')} AS href, trim({d.rep("coalesce(try_element_at(t, i + 1), '')", '<[^>]*>|\\s+', ' ')}) AS anchor
        FROM (SELECT page_id, {host(d, 'url')} AS host, t, posexplode(h) AS (i, href) FROM (SELECT page_id, url, {hrefs} AS h, {texts} AS t FROM pages) a) b"""


def mailed_documents(d: Dialect) -> str:
    """Documents that may hold an address; their reserved test domain, which the rules drop as junk, is renamed."""
    return "SELECT doc_id, replace(text, 'example.', 'sample-site.') AS text FROM documents WHERE contains(text, '@')"


def doc_emails(d: Dialect) -> str:
    """Addresses of documents."""
    from ..functions.emails import found

    return f"SELECT doc_id, {d.explode(found(d, 'text'))} AS email FROM mailed_documents"


#: name -> (builder, other views that it reads)
VIEWS = {
    "leads": (leads, []),
    "leads_dup": (leads_dup, ["leads"]),
    "existing": (existing, ["leads"]),
    "first_names": (first_names, []),
    "business_words": (business_words, []),
    "newcomers": (newcomers, ["leads"]),
    "fallback_leads": (fallback_leads, ["leads"]),
    "source_runs": (source_runs, []),
    "requests": (requests, ["leads"]),
    "later": (later, ["existing"]),
    "found_emails": (found_emails, ["leads"]),
    "site_emails": (site_emails, ["leads"]),
    "verdicts": (verdicts, []),
    "companies": (companies, []),
    "company_codes": (company_codes, []),
    "controllers": (controllers, []),
    "fetched": (fetched, []),
    "officers": (officers, []),
    "places": (places, []),
    "usage": (usage, []),
    "page_text": (page_text, []),
    "rich_pages": (rich_pages, []),
    "linked_pages": (linked_pages, []),
    "person_pages": (person_pages, []),
    "listing_pages": (listing_pages, []),
    "site_links": (site_links, []),
    "mailed_documents": (mailed_documents, []),
    "doc_emails": (doc_emails, ["mailed_documents"]),
}


def with_views(d: Dialect, names: list[str]) -> str:
    """A WITH clause that defines the views and what they read."""
    order: list[str] = []

    def add(n):
        for x in VIEWS[n][1]:
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][0](d)})" for n in order) + " " if order else ""
