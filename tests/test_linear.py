"""Work that follows the input: long runs, pages scanned once, and what is found for a page found once."""

import random
import re
import time

from pyspark.sql import functions as F

from leadlake.functions import emails as E
from leadlake.functions import rules as R
from leadlake.functions.dialect import DUCK, SPARK
from leadlake.operators import core, joins, texts
from leadlake.plans import pipelines, queries
from leadlake.sources import structure


def plain_found(text):
    """The rule of found() with patterns that try every place."""
    padded = re.sub("[^a-zA-Z0-9._%+@-]+", "  ", text) + " "
    known = [m.group(1) for m in re.finditer("(?i)([a-z0-9._%+-]+@[a-z0-9.-]+\\.(" + R.KNOWN_TLDS + "))[^a-z.]", padded)]
    loose = [m.group(1) for m in re.finditer("([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,4})[^a-zA-Z]", padded)]
    return [e for e in known or loose if not any(w in e.lower() for w in R.EMAIL_JUNK)]


def test_addresses_equal_those_of_the_plain_patterns(spark):
    rng = random.Random(4)
    parts = ["a", "Bo", "1", ".", "-", "_", "%", "@", "@", " ", ",", "é", ".com", ".co.uk", ".org", ".xyz", ".io", "com", "9", "+"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(4000)] + [(-1, "x@a.com1c@d.org"), (-2, "x@a.com@b.org 1@2.uk."), (-3, "")]
    df = spark.createDataFrame([*rows, (-4, None)], "id int, text string")
    got = {r.id: r.found for r in df.select("id", F.expr(E.found(SPARK, "text")).alias("found")).collect()}
    assert got.pop(-4) is None
    assert got == {i: plain_found(t) for i, t in rows}
    assert sum(map(len, got.values())) > 100


def test_addresses_are_found_in_linear_time_beside_long_runs(spark):
    df = spark.createDataFrame([("x" * 400_000 + " me@site.org " + "y." * 200_000 + "@",)], "text string")
    began = time.time()
    assert df.select(F.expr(E.found(SPARK, "text"))).first()[0] == ["me@site.org"]
    assert time.time() - began < 20


def counted(spark, n):
    """Pages, and how often one was read."""
    read = spark.sparkContext.accumulator(0)
    html = "<footer><a href='mailto:me@site.org'>m</a></footer><h2>Emma Jones</h2><p>Director</p><script type='application/ld+json'>{\"a\":{\"b\":{\"email\":\"it@site.org\"}}}</script>"

    def page(i):
        read.add(1)
        return html

    udf = F.udf(page, "string").asNondeterministic()
    return spark.range(n).select(F.col("id").alias("page_id"), F.lit("search").alias("kind"), udf("id").alias("html")), read


def test_pages_are_scanned_once(spark):
    pages, read = counted(spark, 7)
    for name, job in (("people", structure.people_by_structure), ("blocks", structure.block_emails), ("linked", structure.linked_emails)):
        before = read.value
        assert job.build(pages).count() > 0, name
        assert read.value - before == 7, name
    before = read.value
    structure.listings(pages, structure.LAYOUTS["search"]).count()
    assert read.value - before == 7


def test_a_page_is_searched_before_it_meets_its_leads(spark):
    leads = spark.createDataFrame([("1", "u", "Emma Jones"), ("2", "u", "Laura Evans"), ("3", "v", "Emma Jones")], "lead_id string, website string, principal_name string")
    pages = spark.createDataFrame([("u", "write to me@site.org now"), ("v", "no address")], "url string, text string")
    df = pipelines.fast_path(leads=leads, page_text=pages)
    assert sorted(map(tuple, df.collect())) == [("1", "me@site.org", 4), ("2", "me@site.org", 4), ("3", None, 2)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan[: plan.index("Join")]


def test_surnames_are_looked_up_in_words_of_places_each_once(spark):
    sides = []
    kept = core.written

    def written(df, name):
        sides.append((name, kept(df, name)))
        return sides[-1][1]

    leads = spark.createDataFrame([("1", "Acme", "Emma Jones", "Woking, GU1"), ("2", "Zed", "Al O'Brien-Ng", "Hill, GU2")], "lead_id string, company_name string, contact_name string, location string")
    places = spark.createDataFrame([(i, f"p{i}", f"The {n} House", "GU7 2AB") for i, n in enumerate(["Jonesy", "Joneses", "Jonesy", "Mr.O'Brien-Ngs"] * 5)], "pos long, place_id string, display_name string, address string")
    core.written = written
    try:
        df = joins.link_places(leads=leads, places=places)
        assert sorted(map(tuple, df.collect())) == [("1", "p0", 3), ("2", "p3", 3)]
    finally:
        core.written = kept
    words = dict(sides)["jw"]
    assert sorted((r.word, r.pos) for r in words.collect()) == [("house", 0), ("joneses", 1), ("jonesy", 0), ("mr.o'brien-ngs", 3)]


def test_a_team_page_is_looked_for_before_the_page_meets_its_leads(spark):
    leads = spark.createDataFrame([("1", "u", None, None), ("2", "u", None, None), ("3", "v", None, None), ("4", None, "larger", None)], "lead_id string, website string, size_signal string, date_of_creation date")
    pages = spark.createDataFrame([("u", "<p>Meet the team</p>"), ("v", None)], "url string, html string")
    df = texts.size_signal(leads=leads, page_text=pages)
    assert sorted(map(tuple, df.collect())) == [("1", "larger"), ("2", "larger"), ("3", "small_new"), ("4", "small_new")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "meet the team" not in plan[: plan.index("Join")]


def test_signals_of_pages_equal_those_of_the_plain_patterns(spark):
    rng = random.Random(5)
    lists = {"text_town": R.GEO_TOWNS, "x_exclude": R.EXCLUDE_TEXT, "x_shell": R.SHELL_TEXT, "x_dormant": R.DORMANT_TEXT, "x_scope": R.REVIEW_TEXT}
    words = [w for ws in lists.values() for w in ws] + ["x", "us", "GU2 7AB", "gu12", "-", ""]
    gaps = [" ", " ", "  ", "\n\t", ",", "s", "_", "é", " "]
    rows = [(str(i), "".join(rng.choice(gaps) + rng.choice([str.upper, str.lower, str])(rng.choice(words)) for _ in range(rng.choice([0, 1, 2, 3, 45, 60])))) for i in range(1500)]
    rows += [(f"n{n}{gap}", gap.join(["a"] * n)) for n in (48, 49, 50, 51) for gap in (" ", " \n ")] + [(f"e{n}", " " * k + "a " * n) for n in (47, 48, 49, 50) for k in (0, 3)]
    plain = {n: "\\b(?:" + "|".join(w.lower() for w in ws) + ")\\b" for n, ws in lists.items()}
    want = [F.expr(SPARK.match("lower(text)", p)).alias(n) for n, p in plain.items()] + [F.expr("size(split(text, r'\\s+')) < 50").alias("thin")]
    df = spark.createDataFrame([*rows, ("null", None)], "url string, text string")
    found = core.query(texts.geo_page(SPARK), page_text=df).select("url", *lists, "thin")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, df.select("url", *want).collect()))
    for n in (*lists, "thin"):
        assert {r[0] for r in found.select(n).distinct().collect()} == {True, False, None}
    blanks = spark.createDataFrame([("".join(rng.choice(" \t\n\r\f\x0bab ") for _ in range(rng.randint(0, 12))),) for _ in range(2000)], "x string")
    for r in blanks.select("x", F.expr(SPARK.squeeze("x")).alias("y")).collect():
        assert r.y == re.sub("[ \t\n\x0b\f\r]+", " ", r.x)


def test_only_offices_are_linked_and_only_their_pages_searched(spark):
    sides = {}
    kept = core.written

    def written(df, name):
        sides[name] = (df._jdf.queryExecution().optimizedPlan().toString(), kept(df, name))
        return sides[name][1]

    core.written = written
    try:
        rows = queries.queries()["p3_office_enrich"](spark, "/root/testdata/sf0.001").count()
    finally:
        core.written = kept
    plan, pages = sides["own_pages"]
    assert "regexp_replace" in plan[: plan.index("LeftSemi")]  # what costs most stands above the join that leaves pages out
    offices = sides["own"][1]
    assert offices.where("category <> 'office'").count() == 0 and rows >= offices.count() > 0
    assert sides["jl"][1].count() == offices.count()
    named = {r.website for r in offices.select("website").distinct().collect()}
    assert {r.url for r in pages.select("url").collect()} <= named
    assert pages.count() < spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_offices_with_rows_and_pages_that_repeat_equal_the_plain_sql(spark):
    import duckdb

    lead = "lead_id string, company_name string, contact_name string, location string, category string, email string, contact_email string, generic_email string, email_guessed boolean, website string, size_signal string, date_of_creation date"
    rows = [
        ("1", "Acme Therapy", "Emma Jones", "Woking, GU1 1AA", "office", "a@u.org", None, None, None, "u", None, None),
        ("1", "Surrey Law", "Al Brown", "Hill", "unit8", None, None, None, True, "v", None, None),  # the same number in another category
        ("2", "Zed", None, None, "office", None, None, "x@w.org", None, "w", "larger", None),
        ("3", "Hill Physio", "Laura Evans", "Guildford", "unit8", None, None, None, None, "u", None, None),
        ("4", None, "nan", "", "office", None, "c@u.org", None, None, None, "small_new", None),
        ("5", "Acme Holdings Group", "Bo Evans", "Farnham", None, None, None, None, None, "u", None, None),
    ]
    tables = {
        "leads": (lead, rows),
        "places": ("pos long, place_id string, display_name string, address string", [(0, "p0", "Acme Therapy Rooms", "Woking, GU1"), (1, "p1", "Zed", "Hill"), (2, "p2", "Surrey Law Jones", "GU7 2AB"), (3, "p3", None, None)]),
        "page_text": ("url string, html string, text string", [("u", "our team", "in Surrey " + "a " * 60), ("u", "<p>", "thin tier 2"), ("v", None, None), ("w", "x", ""), ("z", "our people", "x")]),
    }
    frames = {n: spark.createDataFrame(data, schema) for n, (schema, data) in tables.items()}
    duck = duckdb.connect()
    for n, (schema, data) in tables.items():
        duck.execute(f"CREATE TABLE {n} ({schema.replace('long', 'bigint').replace('string', 'varchar')})")
        duck.executemany(f"INSERT INTO {n} VALUES ({', '.join('?' * len(data[0]))})", data)
    key = lambda r: tuple(str(v) for v in r)
    got = sorted(map(key, pipelines.office_enrich(**frames).collect()))
    assert got == sorted(map(key, duck.execute(pipelines.office_enrich.sql(DUCK)).fetchall()))
    assert got == sorted(map(key, core.query(pipelines.office_enrich.sql(SPARK), **frames).collect()))
    assert len(got) > 4
