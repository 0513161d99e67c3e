"""People, addresses and listings of landed pages, read from the table of their elements and from their linked data.

`markup.elements` gives the structure; every rule here is a Spark expression over
it, so names, roles and selectors stay data that a caller can replace.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import emails as E
from ..functions import names as N
from ..functions import rules as R
from ..functions.dialect import SPARK
from ..operators.core import job
from ..operators.texts import like_name
from .markup import Zone, elements
from .store import written

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]

# fixed values: classes, words and sentences by which pages show people
ABOUT = "about|team|management|staff|bio|profile|founder|owner"
TEAM = "team|staff|people|about|bio|profile|clinician|practitioner|therapist|expert|member|leadership|instructor|coach|specialist|doctor"
CARD = "card|member|person|author|bio|profile|avatar"
CONTACT = "footer|contact|details"
ROLES = "founder|owner|director|ceo|principal|proprietor|partner|therapist|physiotherapist|osteopath|chiropractor|practitioner|clinician|consultant|specialist|coach|instructor|doctor|dentist|surgeon|physician|teacher|counsellor|nutritionist|dietitian|acupuncturist|reflexologist|homeopath|nurse|midwife|paramedic|pharmacist|optometrist|podiatrist|audiologist"
CONTEXT = "founder|owner|director|therapist|practitioner|principal|clinician|osteopath|chiropractor|physiotherapist|psychologist|counsellor|counselor|nutritionist|instructor|coach|doctor|dentist|about me|meet|introducing|welcome"
NEAR = [
    "(?i:founder|owner|director|ceo|principal|proprietor)[:\\s]+([A-Z][a-z]+\\s+[A-Z][a-z]+)",
    "([A-Z][a-z]+\\s+[A-Z][a-z]+)[,\\s]+(?i:founder|owner|director|ceo|principal)",
    "Dr\\.?\\s+([A-Z][a-z]+\\s+[A-Z][a-z]+)",
]
SENTENCES = [
    "(?:founded|run|owned|led|managed|created)\\s+by\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)",
    "([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\s+(?:is|are)\\s+(?:the|our|a)\\s+(?:founder|owner|director|principal)",
    "(?:I'm|I am|My name is|Hi,?\\s+I'm)\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)",
    "(?:[Mm]eet|[Ii]ntroducing|[Ww]elcome)\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)",
]
PERSON_FIELDS = ["founder", "author", "employee", "member"]

BOXES = frozenset({"section", "div", "article"})
ZONES = {
    "about": Zone(ABOUT, BOXES),
    "team": Zone(TEAM, BOXES | {"main"}),
    "card": Zone(CARD, frozenset({"div", "article", "li"})),
    "contact": Zone(CONTACT, None, True, frozenset({"footer"})),
}
#: Sources of people in their order; the first eight can give the page's main contact.
SOURCES = ["author", "linked_name", "role_text", "about_section", "heading_role", "heading_first_name", "text_pair", "title", "heading_team", "team_section", "linked_person", "image", "sentence", "card"]


def _likely(name: str) -> Column:
    return F.expr(like_name(SPARK, name))


def _valid(name: str) -> Column:
    return F.expr(N.contact_valid(SPARK, name))


def _from(source: str, rows: DataFrame, name: Column, title: Column | None = None) -> DataFrame:
    return rows.select("page_id", F.lit(SOURCES.index(source) + 1).alias("source_rank"), "pos", F.trim(name).alias("name"), (F.lit(None).cast("string") if title is None else title).alias("title"))


def linked(scripts: DataFrame) -> DataFrame:
    """page_id, pos, depth, key, owner (the key of the object or list that holds it), value of every node of the linked data of (page_id, pos, text) rows.

    A list's items have the list's key.  Broken JSON gives none.  The descent goes
    level by level until nothing is nested any more.
    """
    level = scripts.select("page_id", "pos", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("owner"), F.try_parse_json("text").alias("value")).where("value IS NOT NULL")
    level = written(level, "nodes")
    levels = [level]
    while True:
        inside = F.expr("schema_of_variant(value)")
        nested = level.where(inside.startswith("OBJECT") | inside.startswith("ARRAY"))
        spark = level.sparkSession
        view = f"nodes_{uuid.uuid4().hex[:8]}"
        nested.createOrReplaceTempView(view)
        level = spark.sql(f"SELECT n.page_id, n.pos, n.depth + 1 AS depth, coalesce(e.key, n.key) AS key, CASE WHEN e.key IS NULL THEN n.owner ELSE n.key END AS owner, e.value FROM {view} n, LATERAL variant_explode(n.value) e")
        spark.catalog.dropTempView(view)
        level = written(level, "nodes")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)


def scripts_of(table: DataFrame) -> DataFrame:
    return table.where("tag = 'script' AND lower(attrs['type']) = 'application/ld+json'").select("page_id", "pos", "text")


def _text(node: str) -> Column:
    return F.expr(f"try_variant_get({node}, '$', 'string')")


def people(table: DataFrame, most_deep: int = 8, first_sections: int = 3) -> DataFrame:
    """Every person that any source of a page gives: page_id, source, source_rank, pos, name, title; each name once a source, at its first place.

    `table` is that of `markup.elements` with `ZONES`.  Sources are those of
    `SOURCES`; names must look like one and, but for the first two, pass the contact
    test.  A team of headings counts from three on; image, sentence and card give
    `most_deep` a page together.
    """
    table = written(table, "scanned")  # pages are scanned once, however many sources read them
    here = Window.partitionBy("page_id").orderBy("pos")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    # what follows, nearest last: a frame that grows, where one up to the end would be read anew for each row
    after = Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy("page_id", "parent").orderBy("pos")
    among = lambda *tags: F.when(F.col("tag").isin(*tags), F.col("text"))
    own = table.where("tag <> '#text'").join(table.select("page_id", F.col("pos").alias("parent"), F.col("text").alias("around")), ["page_id", "parent"], "left")
    own = own.withColumns(
        {
            "next": F.last(among("p", "span", "div", "em", "small", "li"), True).over(after),
            "next_name": F.last(among("h2", "h3", "h4", "strong", "b", "p"), True).over(after),
            "next_any": F.last(among("p", "span", "div", "h2", "h3", "h4", "h5"), True).over(after),
            "last_any": F.last(among("p", "span", "div", "h2", "h3", "h4"), True).over(before),
            "sibling": F.lead("text").over(beside),
        }
    )
    # judged once: all that could be a name
    own = written(own.withColumn("likely", F.coalesce(_likely("text"), F.lit(False))).withColumn("valid", F.col("likely") & F.coalesce(_valid("text"), F.lit(False))), "elements")
    role = lambda c, most: F.when((F.length(c) < most) & (F.lower(c) != F.lower("text")) & F.lower(c).rlike(ROLES), F.substring(c, 1, 80))
    heading = own.where(F.col("tag").isin(HEADINGS))
    out = []

    out.append(_from("author", table.where("tag = 'meta' AND lower(attrs['name']) = 'author'"), F.expr("attrs['content']")))

    nodes = written(linked(scripts_of(table)), "linked")
    names = nodes.where("key = 'name'").withColumn("name", _text("value"))
    out.append(_from("linked_name", names.where(F.col("owner").isin(PERSON_FIELDS) | (F.col("depth") == 1)), F.col("name")))
    plain = nodes.where(F.col("key").isin(PERSON_FIELDS)).withColumn("name", _text("value"))
    out.append(_from("linked_name", plain.where(F.expr("schema_of_variant(value) = 'STRING'")), F.col("name")))
    persons = nodes.where(F.col("key").isin(PERSON_FIELDS)).withColumn("name", F.expr("try_variant_get(value, '$.name', 'string')")).withColumn("title", F.expr("coalesce(try_variant_get(value, '$.jobTitle', 'string'), try_variant_get(value, '$.roleName', 'string'))"))
    out.append(_from("linked_person", persons.where("name IS NOT NULL"), F.col("name"), F.substring("title", 1, 80)))

    text = own.where(F.col("text").isNotNull() & F.lower("text").rlike(f"{ROLES}|dr[. ]"))
    near = F.coalesce(*(F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in NEAR))
    follows = F.when(F.lower("text").rlike(ROLES) & _likely("next_name"), F.col("next_name"))
    out.append(_from("role_text", text.where(F.col("tag").isin("p", "span", "li", "td", "div", "strong", "b", "em", "small", *HEADINGS)), F.coalesce(near, follows)))

    section = Window.partitionBy("page_id").orderBy(F.expr("zones['about']"))
    about = own.where("zones['about'] IS NOT NULL").withColumn("nth", F.dense_rank().over(section)).where(F.col("nth") <= first_sections)
    out.append(_from("about_section", about.where(F.col("likely") & F.col("tag").isin("h2", "h3", "h4", "h5", "strong", "b", "span")), F.col("text")))

    context = F.lower(F.concat_ws(" ", "around", F.substring("next_any", 1, 200), F.substring("last_any", 1, 200)))
    nth = F.row_number().over(here)
    out.append(_from("heading_role", heading.where(F.col("tag").isin("h1", "h2", "h3", "h4")).withColumn("nth", nth).where((F.col("nth") <= 15) & F.col("valid") & context.rlike(CONTEXT)), F.col("text")))
    bare = F.filter(F.split("text", "\\s+"), lambda w: ~F.regexp_replace(F.lower(w), "\\.+$", "").isin("dr", "mr", "mrs", "ms", "miss", "prof", "professor"))
    known = heading.where(F.col("tag").isin("h1", "h2")).withColumn("nth", nth).where((F.col("nth") <= 6) & F.col("valid")).withColumn("bare", bare)
    out.append(_from("heading_first_name", known.where(F.size("bare").between(2, 3) & F.regexp_replace(F.lower(F.get("bare", F.lit(0))), "['-]", "").isin(R.FIRST_NAMES)), F.col("text")))

    pieces = table.where("tag = '#text' AND chars <= 2000").withColumn("pair", F.explode(F.regexp_extract_all("text", F.lit("(?=\\b([A-Z][a-z]{2,} [A-Z][a-z]{2,})\\b)"), F.lit(1))))
    out.append(_from("text_pair", pieces, F.col("pair")))
    out.append(_from("title", table.where("tag = 'title'"), F.regexp_extract("text", "^([A-Z][a-z]+\\s+[A-Z][a-z]+)", 1)))

    titled = F.coalesce(role(F.col("sibling"), 150), role(F.col("next"), 150), F.when(F.lower("text").rlike("^(dr[ .]|prof[ .]|professor )"), F.lit("Doctor")))
    team = heading.where("valid").withColumn("title", titled)
    many = team.groupBy("page_id").agg(F.count_distinct(F.lower("text")).alias("n")).where("n >= 3").select("page_id")
    out.append(_from("heading_team", team.join(many, "page_id", "left_semi"), F.col("text"), F.col("title")))
    inside = own.where(F.expr("zones['team'] IS NOT NULL") & F.col("valid") & F.col("tag").isin("h2", "h3", "h4", "h5", "strong", "b"))
    out.append(_from("team_section", inside.join(many, "page_id", "left_anti"), F.col("text"), F.coalesce(role(F.col("sibling"), 100), role(F.col("next"), 100))))

    image = _from("image", table.where("tag = 'img'"), F.expr("attrs['alt']"))
    said = own.where(F.col("tag").isin("p", "span", "li", "td") & (F.col("chars") <= 200))
    said = said.withColumn("name", F.coalesce(*(F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in SENTENCES)))
    card = Window.partitionBy("page_id", F.expr("zones['card']")).orderBy("pos")
    cards = own.where(F.expr("zones['card'] IS NOT NULL") & F.col("valid") & F.col("tag").isin("h2", "h3", "h4", "h5", "strong", "b", "span")).withColumn("nth", F.row_number().over(card)).where("nth = 1")
    deep = image.unionByName(_from("sentence", said, F.col("name"))).unionByName(_from("card", cards, F.col("text")))

    def kept(rows: DataFrame) -> DataFrame:
        """Rows whose name passes, each name once a source."""
        rows = rows.where(_likely("name")).where((F.col("source_rank") <= 2) | F.coalesce(_valid("name"), F.lit(False)))
        once = rows.groupBy("page_id", "source_rank", F.lower("name").alias("low")).agg(F.min(F.struct("pos", "name", "title")).alias("f"))
        return once.select("page_id", "source_rank", "f.pos", "f.name", "f.title")

    found = kept(reduce(DataFrame.unionByName, out))
    few = kept(deep).withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("source_rank", "pos"))).where(F.col("nth") <= most_deep).drop("nth")
    named = F.element_at(F.array(*map(F.lit, SOURCES)), F.col("source_rank"))
    return found.unionByName(few).select("page_id", named.alias("source"), "source_rank", "pos", "name", "title")


@job("T35S", "person_pages")
def people_by_structure(person_pages: DataFrame) -> DataFrame:
    """Persons of each page by all sources, and whether one is the page's main contact: the first of the first source, of the leading eight, that gives any."""
    found = written(people(elements(person_pages, ZONES)), "people")
    first = found.where("source_rank <= 8").groupBy("page_id").agg(F.min(F.struct("source_rank", "pos", "name")).alias("f"))
    main = F.coalesce((F.col("source_rank") == F.col("f.source_rank")) & (F.col("name") == F.col("f.name")), F.lit(False))
    return found.join(first, "page_id", "left").select("page_id", "source", "source_rank", "pos", "name", "title", main.alias("main_contact"))


def _linked_sql(d) -> str:
    bodies = d.extract_all("html", '(?is)<script[^>]*application/ld[+]json[^>]*>(.*?)</script>', 1)
    return f"""SELECT DISTINCT page_id, email FROM (SELECT page_id, {E.cleaned(d, "replace(lower(raw), 'mailto:', '')")} AS email FROM (
        SELECT s.page_id, json_extract_string(t.atom, '$') AS raw FROM (SELECT page_id, unnest({bodies}) AS body FROM linked_pages) s, json_tree(s.body) t
        WHERE json_valid(s.body) AND t.key IN ('email', 'contactPoint') AND t.type = 'VARCHAR') a WHERE contains(raw, '@')) b WHERE email IS NOT NULL"""


@job("T5S", "linked_pages", plain=_linked_sql)
def linked_emails(linked_pages: DataFrame) -> DataFrame:
    """Addresses of a page's linked data wherever they stand: values of `email` and `contactPoint` at any depth, through lists and graphs; broken JSON gives none."""
    nodes = linked(scripts_of(elements(linked_pages, {})))
    raw = nodes.where("key IN ('email', 'contactPoint')").withColumn("raw", _text("value")).where("contains(raw, '@') AND schema_of_variant(value) = 'STRING'")
    return raw.select("page_id", F.expr(E.cleaned(SPARK, "replace(lower(raw), 'mailto:', '')")).alias("email")).where("email IS NOT NULL").distinct()


@job("T4S", "linked_pages")
def block_emails(linked_pages: DataFrame) -> DataFrame:
    """Addresses of each page by where they stand: mail links, then texts and mail links of footer, contact and detail blocks, then attributes, then other texts; each once, by its best source and first place."""
    table = elements(linked_pages, {"contact": ZONES["contact"]})
    mails = lambda c: F.expr(f"coalesce({E.found(SPARK, c)}, array())")
    link = F.expr("split(regexp_replace(attrs['href'], '(?i)^mailto:', ''), '[?]')[0]")
    block = F.expr("zones['contact'] IS NOT NULL")
    is_mail = F.expr("tag = 'a' AND lower(attrs['href']) LIKE 'mailto:%'")
    shown = F.expr("concat_ws(' ', transform(filter(map_entries(attrs), x -> x.key IN ('alt', 'title', 'content', 'aria-label') OR startswith(x.key, 'data-')), x -> x.value))")
    # one pass: each element gives what it shows by its kind, so that pages are scanned once
    given = lambda rank, found: F.transform(found, lambda x: F.struct(rank.alias("source_rank"), x.alias("raw")))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<source_rank: INT, raw: STRING>>)")
    is_text = F.col("tag") == "#text"
    links = F.when(is_mail, given(F.when(block, 2).otherwise(1), F.array(link))).otherwise(none)
    shows = F.when(is_text, given(F.when(block, 2).otherwise(4), mails("text"))).when(F.contains("shown", F.lit("@")), given(F.lit(3), mails("shown"))).otherwise(none)
    each = table.withColumn("shown", F.when(~is_text, shown)).where(is_mail | (is_text & F.contains("text", F.lit("@"))) | F.contains("shown", F.lit("@")))
    each = each.select("page_id", "pos", F.explode(F.concat(links, shows)).alias("one")).select("page_id", "pos", "one.source_rank", "one.raw")
    each = each.withColumn("email", F.expr(E.cleaned(SPARK, "lower(raw)"))).where(F.expr(f"email IS NOT NULL AND NOT {SPARK.word("split_part(email, '@', 1)", R.JUNK_LOCALS)}"))
    return each.groupBy("page_id", "email").agg(F.min(F.struct("source_rank", "pos")).alias("f")).select("page_id", "email", "f.source_rank", "f.pos")


@dataclass(frozen=True)
class Layout:
    """How a kind of listing page shows its entries: conditions over an element's tag and attributes, the first that anything fits counts."""

    blocks: tuple[Zone, ...]
    name: tuple[str, ...]
    link: tuple[str, ...]
    address: tuple[str, ...] = ()
    description: tuple[str, ...] = ()
    dead: tuple[str, ...] = ()
    foreign: bool = False  # whether links must lead elsewhere, not to search engines and networks
    named_by_link: bool = False


def _class(word: str, tag: str | None = None) -> str:
    return f"contains(coalesce(attrs['class'], ''), '{word}')" + (f" AND tag = '{tag}'" if tag else "")


# fixed values: the selectors of the three kinds of listing, with their fallbacks
LAYOUTS = {
    "registry": Layout((Zone("type-company", frozenset({"li"})), Zone("results-list-item", frozenset({"li"}))), (), ("tag = 'a' AND attrs['href'] IS NOT NULL",), ("tag = 'p'", "tag = 'dd'", _class("address")), (), (_class("meta", "span"), _class("status"), _class("meta")), named_by_link=True),
    "directory": Layout((Zone("businessCapsule(?!-)", BOXES), Zone("businessCapsule(?!-)")), ("tag = 'h2'", _class("businessCapsule--name", "a"), _class("name")), ("tag = 'a' AND attrs['data-tracking'] = 'WEBSITE'", _class("businessCapsule--callToAction", "a"), "tag = 'a' AND contains(attrs['href'], 'http')"), (_class("address", "span"), "tag = 'address'", _class("address")), (_class("businessCapsule--description", "p"), _class("description"))),
    "search": Layout((Zone("(^|\\s)g(\\s|$)", frozenset({"div"})),), ("tag = 'h3'",), ("tag = 'a' AND attrs['href'] IS NOT NULL",), (), (_class("VwiC3b", "div"), _class("aCOpRe", "span"), "attrs['data-content-feature'] IS NOT NULL"), foreign=True),
}


def listings(pages: DataFrame, layout: Layout, most: int = 5) -> DataFrame:
    """page_id, place, name, link, address, description of the first `most` entries of each page of a kind of listing.

    Entries without a name are none; dead companies are dropped and, of search
    results, links that are not absolute or lead to search engines and networks.
    """
    zones = {f"block{i}": z for i, z in enumerate(layout.blocks)}
    table = written(elements(pages, zones), "scanned")
    # the first kind of block that a page has
    names = list(zones)
    kind = table.groupBy("page_id").agg(*(F.max(F.expr(f"zones['{n}'] IS NOT NULL")).alias(n) for n in names))
    used = F.coalesce(*(F.when(F.col(n), F.lit(n)) for n in names))
    inside = table.where("tag <> '#text'").join(kind.select("page_id", used.alias("used")).where("used IS NOT NULL"), "page_id").withColumn("block", F.expr("zones[used]")).where("block IS NOT NULL")

    def first(conditions: tuple[str, ...], value: str) -> Column:
        """The value of the first element, by condition and then place."""
        if not conditions:
            return F.lit(None).cast("string")
        rank = F.coalesce(*(F.when(F.expr(f"({c}) AND pos > block"), F.lit(i)) for i, c in enumerate(conditions)))
        return F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("pos"), F.expr(value).alias("value"))))["value"]

    entry = inside.groupBy("page_id", "block").agg(
        first(layout.link if layout.named_by_link else layout.name, "text").alias("name"), first(layout.link, "attrs['href']").alias("link"), first(layout.address, "text").alias("address"), first(layout.description, "text").alias("description"), first(layout.dead, "text").alias("state")
    )
    ok = F.expr("name <> '' AND NOT coalesce(lower(state) RLIKE 'dissolved|liquidation|struck off|closed', false)")
    if layout.foreign:
        ok &= F.expr("startswith(link, 'http') AND NOT lower(link) RLIKE 'google|youtube|facebook|twitter|linkedin.com/pulse'")
        entry = entry.withColumn("name", F.expr("trim(regexp_replace(name, '( - | \\\\| | – | :: | — ).*$', ''))"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("block"))
    return entry.where(ok).withColumn("place", place).where(F.col("place") <= most).select("page_id", "place", "name", "link", "address", F.substring("description", 1, 200).alias("description"))


@job("S11S", "listing_pages")
def listing_layouts(listing_pages: DataFrame, most: int = 5) -> DataFrame:
    """Entries of listing pages (`kind` tells the layout) of all three kinds."""
    each = [listings(listing_pages.where(F.col("kind") == kind), layout, most).withColumn("kind", F.lit(kind)) for kind, layout in LAYOUTS.items()]
    return reduce(DataFrame.unionByName, each)
