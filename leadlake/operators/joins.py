"""Joins: anti-joins on several keys, lookups, record linkage and run differences."""

from __future__ import annotations

from ..functions import rules as R
from ..functions.keys import blank, name_key, name_location_key, website_key
from .core import operator


def unknown(d, source: str, columns: str) -> str:
    """Rows of `source` that no known lead shares a place, website or name and location with: one hash anti-join a key."""
    web = lambda t: website_key(d, f"{t}.website")
    loc = lambda t: name_location_key(f"{t}.company_name", f"{t}.location")
    return f"""SELECT {columns} FROM {source} l
        LEFT ANTI JOIN (SELECT {blank('e.place_id')} AS k FROM existing e WHERE {blank('e.place_id')} IS NOT NULL) a ON l.place_id = a.k
        LEFT ANTI JOIN (SELECT {web('e')} AS k FROM existing e WHERE {web('e')} IS NOT NULL) b ON {web('l')} = b.k
        LEFT ANTI JOIN (SELECT {loc('e')} AS k FROM existing e WHERE {loc('e')} IS NOT NULL) c ON {loc('l')} = c.k""".replace("LEFT ANTI", "ANTI" if d.duck else "LEFT ANTI")


@operator("J1", "leads", "existing")
def anti_existing(d):
    """New leads that share no key with a known one."""
    return unknown(d, "leads", "l.lead_id, l.ingest_seq")


@operator("J2", "leads", "existing")
def anti_existing_office(d):
    """Office leads not known by name, then not by website."""
    anti = "ANTI" if d.duck else "LEFT ANTI"
    return f"""SELECT l.lead_id, l.ingest_seq FROM leads l {anti} JOIN (SELECT {name_key('company_name')} AS k FROM existing) a ON {name_key('l.company_name')} = a.k
        {anti} JOIN (SELECT {website_key(d, 'website')} AS k FROM existing) b ON {website_key(d, 'l.website')} = b.k WHERE l.category = 'office'"""


@operator("J3", "leads", "existing")
def fill_principals(d):
    """Principals from a lookup by company name, last row of a name wins, only where missing."""
    best = lambda c: f"max_by(x.{c}, x.ingest_seq)"
    return f"""SELECT l.lead_id, coalesce(l.principal_name, p.pn) AS principal_name, coalesce(l.principal_email_guess, p.pg) AS principal_guess FROM leads l
        LEFT JOIN (SELECT k, {best('pn')} AS pn, {best('pg')} AS pg FROM (SELECT {name_key('company_name')} AS k, ingest_seq, coalesce(principal_name, '') AS pn, coalesce(principal_email_guess, '') AS pg FROM existing WHERE principal_name IS NOT NULL OR principal_email_guess IS NOT NULL) x GROUP BY k) p
        ON {name_key('l.company_name')} = p.k"""


@operator("J4", "company_codes")
def sector_from_sic(d):
    """Sector of each company: the first of its codes, in order, that the dimension knows."""
    dim = " UNION ALL ".join(f"SELECT '{c}' AS code, '{s}' AS sector" for s, codes in R.SIC_SECTORS.items() for c in codes)
    return f"""SELECT c.company_number, coalesce(min_by(m.sector, CASE WHEN m.sector IS NOT NULL THEN c.pos END), 'Professional Services') AS sector
        FROM company_codes c LEFT JOIN ({dim}) m ON c.code = m.code GROUP BY c.company_number"""


@operator("J5", "leads")
def town_geo(d):
    """Coordinates of the lead's town, else of Guildford."""
    dim = " UNION ALL ".join(f"SELECT '{t}' AS town, CAST({a} AS DOUBLE) AS lat, CAST({b} AS DOUBLE) AS lng" for t, (a, b) in R.TOWN_COORDINATES.items())
    return f"SELECT l.lead_id, coalesce(t.lat, CAST(51.2362 AS DOUBLE)) AS lat, coalesce(t.lng, CAST(-0.5704 AS DOUBLE)) AS lng FROM leads l LEFT JOIN ({dim}) t ON split_part(l.location, ',', 1) = t.town"


def place_tokens(d, x: str) -> str:
    """Distinct words of a name, punctuation dropped, without stop words."""
    return d.distinct(d.filter(d.split(f"trim({d.rep(f'lower({x})', '[^a-z0-9 ]')})", " +"), "w", f"w <> '' AND NOT {d.word('w', R.PLACE_STOP)}"))


#: Lengths of the parts by which keys are looked up; a key uses the longest that fits into it.
GRAMS = (16, 8, 4, 2, 1)


def held_in(holder: str, x: str, keys: str, key: str, least: int = 1) -> str:
    """(x, key) for each non-empty key, of at least so many characters, that lies in x.

    Each key stands in an index under its rarest part of one of the lengths of
    `GRAMS`, rarest among the holders' parts; holders are probed with their parts
    at all places, and what meets is compared as a whole.  The work follows the
    holders' length (five parts a place), not its square.
    """
    used = [n for n in GRAMS if n >= max(m for m in GRAMS if m <= least)]
    sizes = f"array({', '.join(map(str, used))})"
    own = "CASE " + " ".join(f"WHEN length({key}) >= {n} THEN {n}" for n in used) + " END"
    parts = lambda of, n: f"flatten(transform(sequence(1, length({of})), i -> transform(filter({n}, n -> i + n - 1 <= length({of})), n -> struct(i AS at, substr({of}, i, n) AS gram))))"
    return f"""SELECT DISTINCT {x}, {key} FROM (WITH
        key_parts AS (SELECT {key}, p.at, p.gram FROM (SELECT {key}, explode({parts(key, f'array({own})')}) AS p FROM (SELECT DISTINCT {key} FROM {keys} WHERE length({key}) >= {least}) k) e),
        holder_parts AS (SELECT h.{x}, h.p.at AS at, h.p.gram AS gram FROM (SELECT {x}, explode({parts(x, sizes)}) AS p FROM (SELECT DISTINCT {x} FROM {holder} WHERE {x} <> '') d) h LEFT SEMI JOIN (SELECT DISTINCT gram FROM key_parts) g ON g.gram = h.p.gram),
        times AS (SELECT gram, count(*) AS n FROM holder_parts GROUP BY gram),
        rarest AS (SELECT {key}, min(struct(n, at, gram)) AS r, count(*) AS met FROM (SELECT k.{key}, k.at, k.gram, t.n FROM key_parts k JOIN times t ON t.gram = k.gram) m GROUP BY {key}),
        whole AS (SELECT {key}, r.at AS at, r.gram AS gram FROM rarest WHERE met = length({key}) - length(r.gram) + 1)
        SELECT h.{x}, w.{key} FROM holder_parts h JOIN whole w ON w.gram = h.gram AND substr(h.{x}, h.at - w.at + 1, length(w.{key})) = w.{key} WHERE h.at >= w.at) held"""


def _lead_side(d) -> str:
    w = d.split("lower(trim(contact_name))", "\\s+")
    surname, town = d.at(w, d.size(w)), "lower(split_part(trim(split_part(location, ',', 1)), ' ', 1))"
    return f"SELECT lead_id, {place_tokens(d, 'company_name')} AS cn, CASE WHEN length({town}) > 2 THEN {town} END AS town, CASE WHEN length({surname}) >= 4 THEN {surname} END AS surname FROM leads"


def _place_side(d) -> str:
    return f"SELECT pos, place_id, {place_tokens(d, 'display_name')} AS pn, lower(display_name) AS dn, lower(coalesce(address, '')) AS addr, coalesce({d.match('address', '(?i)\\bGU[0-9]{1,2}\\b')}, false) AS gu FROM places"


def _linked_leads(d) -> str:
    return f"SELECT lead_id, sort_array(cn) AS cn, CAST(ceil(size(cn) / 2) AS INT) AS need, town, surname FROM ({_lead_side(d)}) x"


def _linked_places(d) -> str:
    return f"SELECT pos, place_id, sort_array(pn) AS pn, dn, addr, gu FROM ({_place_side(d)}) x"


def _place_words(d) -> str:
    """The first position of each word of places' names, by address and whether it is plausible. A surname has no blank, so it lies in a name where it lies in a word."""
    each = d.explode(d.distinct(d.split("dn", "\\s+")))
    return f"SELECT word, addr, gu, min(pos) AS pos FROM (SELECT pos, addr, gu, {each} AS word FROM jp) y WHERE length(word) >= 4 GROUP BY word, addr, gu"


def _known_words(d) -> str:
    """Words of places that leads have too."""
    return "SELECT w.pos, w.addr, w.gu, w.token FROM (SELECT pos, addr, gu, explode(pn) AS token FROM jp) w LEFT SEMI JOIN (SELECT DISTINCT explode(cn) AS token FROM jl) l ON l.token = w.token"


def _known_sets(d) -> str:
    """The first position of each set of such words."""
    return "SELECT pn, min(pos) AS pos FROM (SELECT pos, sort_array(collect_set(token)) AS pn FROM jk GROUP BY pos) k GROUP BY pn"


LINK_SIDES = {"jl": _linked_leads, "jp": _linked_places, "jw": _place_words, "jk": _known_words, "sets": _known_sets}


@operator("J6", "leads", "places", sides=LINK_SIDES)
def link_places(d):
    """The best place of each lead: tier 1 half of the name's words, tier 2 a shared word of four letters and a plausible address, tier 3 the contact's surname in the place's name and a plausible address; first position wins inside a tier.

    No word is left out however common it is: places are first reduced to the
    first position of each key (up to three words, surname; with a plausible
    address, also by town), so a join meets one row a key.  Names of seven words
    and more, of which four must agree, are verified on their rarest words.
    """
    if d.duck:  # the rule itself, over all pairs
        near = "(p.gu OR coalesce(contains(p.addr, l.town), false))"
        both = "len(list_intersect(l.cn, p.pn))"
        long = "len(list_filter(list_intersect(l.cn, p.pn), lambda w: length(w) >= 4)) > 0"
        tier = f"CASE WHEN len(l.cn) > 0 AND {both} >= 0.5 * len(l.cn) THEN 1 WHEN {near} AND {long} THEN 2 WHEN coalesce(contains(p.dn, l.surname), false) AND {near} THEN 3 END"
        return f"""SELECT lead_id, place_id, tier FROM (SELECT lead_id, place_id, tier, row_number() OVER (PARTITION BY lead_id ORDER BY tier, pos) AS n FROM (
            SELECT l.lead_id, p.place_id, p.pos, {tier} AS tier FROM ({_lead_side(d)}) l CROSS JOIN ({_place_side(d)}) p) t WHERE tier IS NOT NULL) r WHERE n = 1"""
    pairs = lambda a: f"flatten(transform({a}, (x, i) -> transform(slice({a}, i + 2, size({a})), y -> concat(x, ' ', y))))"
    triples = lambda a: f"flatten(transform({a}, (z, j) -> transform({pairs(f'slice({a}, j + 2, size({a}))')}, y -> concat(z, ' ', y))))"
    sides = "" if d.staged else "".join(f"{n} AS ({build(d)}), " for n, build in LINK_SIDES.items())
    return f"""SELECT lead_id, place_id, tier FROM (WITH {sides}
        town_of AS ({held_in('jp', 'addr', 'jl', 'town', 3)}),
        name_of AS ({held_in('jw', 'word', 'jl', 'surname', 4)}),
        first_key AS (SELECT key, min(pos) AS pos FROM (SELECT pos, explode(concat(pn, {pairs('pn')}, {triples('pn')})) AS key FROM sets) x GROUP BY key),
        few AS (SELECT l.lead_id, 1 AS tier, min(k.pos) AS pos FROM (SELECT lead_id, explode(CASE need WHEN 1 THEN cn WHEN 2 THEN {pairs('cn')} ELSE {triples('cn')} END) AS key FROM jl WHERE need BETWEEN 1 AND 3) l JOIN first_key k ON k.key = l.key GROUP BY l.lead_id),
        rare AS (SELECT lead_id, token FROM (SELECT l.lead_id, l.token, l.need, l.n, row_number() OVER (PARTITION BY l.lead_id ORDER BY coalesce(f.times, 0), l.token) AS place FROM
            (SELECT lead_id, need, size(cn) AS n, explode(cn) AS token FROM jl WHERE need > 3) l LEFT JOIN (SELECT token, count(*) AS times FROM jk GROUP BY token) f ON f.token = l.token) x WHERE place <= n - need + 1),
        many AS (SELECT l.lead_id, 1 AS tier, min(p.pos) AS pos FROM (SELECT DISTINCT r.lead_id, s.pos FROM rare r JOIN (SELECT pos, explode(pn) AS token FROM sets) s ON s.token = r.token) c
            JOIN jl l ON l.lead_id = c.lead_id JOIN sets p ON p.pos = c.pos WHERE size(array_intersect(l.cn, p.pn)) >= l.need GROUP BY l.lead_id),
        long_word AS (SELECT lead_id, town, explode(filter(cn, w -> length(w) >= 4)) AS token FROM jl),
        word_gu AS (SELECT token, min(pos) AS pos FROM jk WHERE gu AND length(token) >= 4 GROUP BY token),
        word_town AS (SELECT w.token, t.town, min(w.pos) AS pos FROM jk w JOIN town_of t ON t.addr = w.addr WHERE length(w.token) >= 4 GROUP BY w.token, t.town),
        shared AS (SELECT l.lead_id, 2 AS tier, min(least(g.pos, t.pos)) AS pos FROM long_word l LEFT JOIN word_gu g ON g.token = l.token LEFT JOIN word_town t ON t.token = l.token AND t.town = l.town GROUP BY l.lead_id),
        named AS (SELECT n.surname, w.addr, w.gu, min(w.pos) AS pos FROM name_of n JOIN jw w ON w.word = n.word GROUP BY n.surname, w.addr, w.gu),
        name_gu AS (SELECT surname, min(pos) AS pos FROM named WHERE gu GROUP BY surname),
        name_town AS (SELECT n.surname, t.town, min(n.pos) AS pos FROM named n JOIN town_of t ON t.addr = n.addr GROUP BY n.surname, t.town),
        person AS (SELECT l.lead_id, 3 AS tier, least(g.pos, t.pos) AS pos FROM jl l LEFT JOIN name_gu g ON g.surname = l.surname LEFT JOIN name_town t ON t.surname = l.surname AND t.town = l.town),
        best AS (SELECT lead_id, min(struct(tier, pos)) AS b FROM (SELECT * FROM few UNION ALL SELECT * FROM many UNION ALL SELECT * FROM shared UNION ALL SELECT * FROM person) u WHERE pos IS NOT NULL GROUP BY lead_id)
        SELECT b.lead_id, p.place_id, b.b.tier AS tier FROM best b JOIN jp p ON p.pos = b.b.pos) linked"""


@operator("J7", "leads", "existing")
def link_registry_by_name(d):
    """The first registry title, of a company that still trades, that contains the lead's name without its legal suffix or lies in it; empty names link to none.

    Containment goes through an index of rare parts, both ways, between distinct
    names and distinct titles, of which the first row stands for all.
    """
    clean = f"lower(trim({d.rep('company_name', '(?i)\\s*(ltd|limited|llp|plc|inc)[.]?\\s*$')}))"
    left, right = f"SELECT lead_id, {clean} AS clean FROM leads WHERE {clean} <> ''", f"SELECT lead_id AS number, ingest_seq AS seq, lower(company_name) AS title FROM existing WHERE coalesce(company_status, '') NOT IN ('dissolved', 'liquidation') AND company_name <> ''"
    if d.duck:  # the rule itself, over all pairs
        return f"SELECT lead_id, number FROM (SELECT l.lead_id, e.number, row_number() OVER (PARTITION BY l.lead_id ORDER BY e.seq) AS n FROM ({left}) l JOIN ({right}) e ON contains(e.title, l.clean) OR contains(l.clean, e.title)) t WHERE n = 1"
    return f"""SELECT lead_id, number FROM (WITH jl AS ({left}), jt AS (SELECT title, min(seq) AS seq FROM ({right}) x GROUP BY title),
        jc AS (SELECT DISTINCT clean FROM jl),
        inside AS (SELECT h.clean AS s, min(t.seq) AS seq FROM ({held_in('jt', 'title', 'jc', 'clean')}) h JOIN jt t ON t.title = h.title GROUP BY h.clean),
        around AS (SELECT h.clean, min(t.seq) AS seq FROM ({held_in('jc', 'clean', 'jt', 'title')}) h JOIN jt t ON t.title = h.title GROUP BY h.clean),
        first AS (SELECT l.lead_id, least(i.seq, a.seq) AS seq FROM jl l LEFT JOIN inside i ON i.s = l.clean LEFT JOIN around a ON a.clean = l.clean)
        SELECT f.lead_id, e.lead_id AS number FROM first f JOIN existing e ON e.ingest_seq = f.seq) linked"""


DIRECTOR = "role IN ('director', 'managing-director', 'corporate-director')"


@operator("J8", "leads", "officers")
def directors_for_pages(d):
    """Most recent active director of each lead's number, else any officer."""
    return f"""SELECT l.lead_id, o.name AS director FROM leads l LEFT JOIN (SELECT company_number, name, row_number() OVER (PARTITION BY company_number ORDER BY CASE WHEN resigned_on IS NULL AND {DIRECTOR} THEN 0 ELSE 1 END, appointed_on DESC, pos) AS n FROM officers) o
        ON o.company_number = l.lead_id AND o.n = 1"""


@operator("J9", "leads", "officers", "controllers")
def principal_for_lead(d):
    """Principal by preference: active director (latest), then a person with control, then any active officer; leads without either keep none."""
    officer = f"SELECT company_number, name, CASE WHEN {DIRECTOR} THEN 1 ELSE 3 END AS pref, appointed_on, pos FROM officers WHERE resigned_on IS NULL"
    control = "SELECT company_number, name, 2 AS pref, CAST(NULL AS DATE) AS appointed_on, pos FROM controllers WHERE ceased_on IS NULL"
    return f"""SELECT l.lead_id, o.name AS principal, o.pref FROM leads l JOIN (SELECT company_number, name, pref, row_number() OVER (PARTITION BY company_number ORDER BY pref, appointed_on DESC, pos) AS n FROM ({officer} UNION ALL {control}) x) o ON o.company_number = l.lead_id AND o.n = 1"""


@operator("J11", "leads", "first_names", "business_words")
def name_word_lists(d):
    """Whether a name begins with a known first name (a semi join of its first word) and holds no business word (an anti join of all its words).

    The lists are tables of one column `word`, handed in by the caller; Spark
    broadcasts them by their size or shuffles.  Null names have no row.
    """
    words = d.split("lower(trim(contact_name))", "\\s+")
    each = f"SELECT lead_id, {d.explode(d.distinct(words))} AS word FROM leads WHERE contact_name IS NOT NULL"
    semi = "SEMI" if d.duck else "LEFT SEMI"
    first = f"SELECT w.lead_id FROM (SELECT lead_id, {d.at(words, '1')} AS word FROM leads) w {semi} JOIN first_names n ON n.word = w.word"
    business = f"SELECT DISTINCT w.lead_id FROM ({each}) w {semi} JOIN business_words b ON b.word = w.word"
    return f"SELECT l.lead_id, f.lead_id IS NOT NULL AS known_first, b.lead_id IS NULL AS no_business_word FROM leads l LEFT JOIN ({first}) f ON f.lead_id = l.lead_id LEFT JOIN ({business}) b ON b.lead_id = l.lead_id WHERE l.contact_name IS NOT NULL"


@operator("J12", "leads", "verdicts")
def apply_verdicts(d):
    """Validation answers joined on the lead; the first by time is applied: confirm, clear, or lower the confidence by one (2 where there is none, 1 at least)."""
    kind = "CASE WHEN contains(upper(answer), 'CONFIRMED') THEN 'CONFIRMED' WHEN contains(upper(answer), 'REJECTED') THEN 'REJECTED' ELSE 'UNCERTAIN' END"
    asked = f"SELECT lead_id, min_by({kind}, answered_at) AS answer FROM verdicts WHERE NOT {d.starts('answer', d.lit('FOUND:'))} AND NOT {d.starts('answer', d.lit('{'))} AND NOT {d.starts('upper(answer)', d.lit('FALSE'))} AND NOT {d.starts('upper(answer)', d.lit('REAL'))} GROUP BY lead_id"
    return f"""SELECT l.lead_id, CASE WHEN v.answer = 'REJECTED' THEN NULL ELSE l.contact_name END AS contact_name, CASE v.answer WHEN 'CONFIRMED' THEN true WHEN 'REJECTED' THEN false ELSE l.contact_verified END AS verified,
        CASE WHEN v.answer = 'UNCERTAIN' THEN greatest(1.0, coalesce(l.confidence_score, 2) - 1) ELSE l.confidence_score END AS confidence
        FROM leads l LEFT JOIN ({asked}) v ON v.lead_id = l.lead_id"""


@operator("J13", "existing", "later")
def run_diff(d):
    """Counts of what changed between two runs over one set of leads."""
    c = lambda t, n: f"count_if({t}) AS {n}"
    sides = [c(f"b.{f} IS NULL AND a.{f} IS NOT NULL", f"gained_{n}") + ", " + c(f"b.{f} IS NOT NULL AND a.{f} IS NULL", f"lost_{n}") + ", " + c(f"b.{f} <> a.{f}", f"replaced_{n}") + ", " + c(f"b.{f} = a.{f}", f"kept_{n}") for f, n in (("contact_name", "contact"), ("email", "email"))]
    return f"""SELECT {', '.join(sides)}, {c('a.lead_id IS NULL', 'only_before')}, {c('b.lead_id IS NULL', 'only_after')} FROM existing b FULL OUTER JOIN later a ON a.lead_id = b.lead_id"""
