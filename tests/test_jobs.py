"""Jobs: agreement of both engines, invariants, files and streams."""

import os

import duckdb
import pytest
from leadlake.operators import filters, joins, reports, rollup, windows
from leadlake.plans import queries, tables
from leadlake.sources import leads as files
from leadlake.streaming import ingest

SF = "/root/testdata/sf0.001"
SOME = ["a1_lead_stats", "a15_batch_stats", "f15_rescrape_reason", "j1_anti_existing", "j6_link_places", "w1_dedupe_keep_enriched", "w7_rank_site_links", "t13_name_verdicts", "t20_names_from_company", "t38_domain_candidates", "u1_replace_email", "p1_refine", "s11_listing_blocks"]


def rows(found):
    return sorted(str(["none" if v is None else round(v, 6) if isinstance(v, float) else v for v in r]) for r in found)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_both_engines_agree(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    order = [want.columns.index(c) for c in got.columns]
    assert rows(map(tuple, got.collect())) == rows(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", ["s1_read_leads_csv", "s3_typed_leads", "s5_checkpoint_leads", "s9_ingest_places", "x1_incremental_ingest", "x2_incremental_dedupe"])
def test_files_and_streams_agree(spark, duck, name):
    got = tables.queries()[name](spark, SF)
    want = duck.sql(tables.oracle_sql()[name])
    order = [want.columns.index(c) for c in got.columns]
    assert rows(map(tuple, got.collect())) == rows(tuple(r[i] for i in order) for r in want.fetchall())


def test_dedupe_is_idempotent_and_partition_free(spark):
    dup = tables.view(spark, SF, "leads_dup")
    once = windows.dedupe_keep_enriched(leads_dup=dup)
    again = windows.dedupe_keep_enriched(leads_dup=dup.join(once.select("lead_id"), "lead_id"))
    assert rows(map(tuple, once.select("lead_id").collect())) == rows(map(tuple, again.select("lead_id").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    shuffled = windows.dedupe_keep_enriched(leads_dup=dup.repartition(7, "email"))
    assert rows(map(tuple, shuffled.collect())) == rows(map(tuple, once.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_histograms_sum_to_the_rows(spark):
    leads = tables.view(spark, SF, "leads")
    n = leads.count()
    assert sum(r.n for r in reports.rescrape_reason_counts(leads=leads).collect()) == n
    assert sum(r.n for r in reports.email_type_histogram(leads=leads).collect()) == n
    excluded = filters.web_presence(leads=leads)
    assert excluded.where("excluded").count() + excluded.where("NOT excluded").count() == n


def test_anti_join_plans_hash_joins(spark):
    leads, existing = (tables.view(spark, SF, n) for n in ("leads", "existing"))
    plan = joins.anti_existing(leads=leads, existing=existing)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and plan.count("LeftAnti") >= 3


def test_missing_input_is_told(spark):
    with pytest.raises(TypeError, match="existing"):
        joins.anti_existing(leads=tables.view(spark, SF, "leads"))


def test_dirty_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('company_name,email_guessed,confidence_score,contact_names,odd,ai_score,contact_name,google_rating,last_enriched_date\n"A ""B"", Ltd\nLine",TRUE,2.0,"a; b | c",1,x,nan,4.5/5 (23 reviews),2024-01-02\nC,,,,2,7,None,4.0/5,soon\n', encoding="utf-8")
    raw = files.read_csv(spark, str(path))
    assert raw.columns == files.LEAD_COLUMNS and raw.count() == 2
    assert "odd" in files.read_csv(spark, str(path), open_schema=True).columns
    a, c = files.typed(raw).orderBy("company_name").collect()
    assert a.company_name == 'A "B", Ltd\nLine' and a.email_guessed is True and a.confidence_score == 2.0 and a.contact_names == ["a", "b", "c"] and a.ai_score is None and a.contact_name is None
    assert a.google_rating.rating == 4.5 and a.google_rating.reviews == 23 and str(a.last_enriched_date) == "2024-01-02"
    assert c.ai_score == 7 and c.contact_name is None and c.google_rating.reviews is None and c.last_enriched_date is None and c.email_guessed is None
    assert files.read_csv(spark, str(tmp_path / "absent.csv")).count() == 0


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = "lead_id string, ingest_seq long, company_name string, website string, location string, email string"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    run = lambda: ingest.incremental_ingest(ingest.files(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema), f"{base}/out", f"{base}/state").awaitTermination()
    add([("1", 1, "A", "http://a.com", "Woking", None), ("2", 2, " a ", None, None, None), ("3", 3, "B", None, "Woking", None)])
    run()
    add([("4", 4, "C", "https://www.a.com/", None, None), ("5", 5, "b", None, None, None), ("6", 6, "D", None, None, None), ("7", 7, "d", None, None, "x@y.z")])
    run()
    run()
    assert sorted(r.lead_id for r in spark.read.parquet(f"{base}/out").collect()) == ["1", "3", "6"]


def test_entry_works_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/leadlake", tmp_path / "leadlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') for n in q); print('fine')"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False).stdout.strip().endswith("fine")


def test_a_large_host_is_gathered_in_bounded_parts(spark, duck):
    pages = spark.range(1500).selectExpr("'big' AS host", "id AS page_id", "concat(repeat(concat(chr(97 + id % 26), ' '), 3000), if(id = 17, ' jo@acme.co.uk', '')) AS text")
    few = spark.createDataFrame([("a", 2, "b"), ("a", 1, "x@y.org a"), ("a", 3, None), ("a", 4, ""), (None, 5, "n"), ("b", 6, None)], "host string, page_id long, text string")
    got = {r.host: r for r in rollup.page_contact_rollup(page_text=pages.unionByName(few)).collect()}
    assert (got["big"].pages, got["big"].text, got["big"].email) == (1500, "a " * 2500, "jo@acme.co.uk")
    assert (got["a"].pages, got["a"].text, got["a"].email) == (4, "x@y.org a b ", "x@y.org") and got[None].text == "n" and got["b"].pages == 1
    # merged in levels, from a few leading pages a task
    many = pages.unionByName(few.where("text IS NOT NULL")).repartition(9)
    want = {r.host: r.text for r in rollup.first_text(many).collect()}
    assert want == {h: r.text for h, r in got.items() if h != "b"} == {r.host: r.text for r in rollup.first_text(many, fan=2).collect()}
    assert rollup.leading([(3, "c" * 9), (1, "a"), (2, "b" * 5)], 6) == [(1, "a"), (2, "b" * 5)]
    assert rollup.page_contact_rollup(page_text=few.limit(0)).count() == 0
    named = spark.createDataFrame([("h", i, f"{n}, Director and {n}, Owner") for i, n in enumerate(["Emma Jones", "Book", "Laura Evans", "Emma Jones"])], "host string, page_id long, text string")
    assert rollup.page_contact_rollup(page_text=named).first().contacts == "Emma Jones; Laura Evans"
    assert rollup.page_contact_rollup({"most_contacts": 1}, page_text=named).first().contacts == "Emma Jones"
    for name in ("a18_page_contact_rollup", "s8_ingest_officers"):
        found = (queries.queries() | tables.queries())[name](spark, SF)
        want = duck.sql((queries.oracle_sql() | tables.oracle_sql())[name])
        order = [want.columns.index(c) for c in found.columns]
        assert rows(map(tuple, found.collect())) == rows(tuple(r[i] for i in order) for r in want.fetchall())
