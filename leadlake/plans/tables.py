"""Registered queries of sources, sinks and streams: each writes and reads the views as files, JSON or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK
from ..operators.arrival import arrivals_sql, ingest_keys
from ..sources import landed
from ..sources import leads as files
from ..sources.store import folder
from ..streaming import ingest
from .views import with_views

COLUMNS = ["company_name", "website", "sector", "contact_name", "email", "location", "ai_score", "category", "enrichment_source", "email_guessed", "contact_names", "refinement_notes", "confidence_score", "date_of_creation"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in ("customer", "pages", "nation", "orders", "part", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(with_views(SPARK, [name]) + f"SELECT * FROM {name}")


def s1_read_leads_csv(spark, sf_dir):
    """Leads written as CSV and read back as text by the fixed schema."""
    path = folder(spark, "csv")
    files.write_csv(view(spark, sf_dir, "leads"), path)
    return files.read_csv(spark, path).select(*COLUMNS)


def s2_read_leads_csv_open(spark, sf_dir):
    """Unknown columns are kept when the schema is open."""
    path = folder(spark, "csv")
    files.write_csv(view(spark, sf_dir, "leads").withColumn("slug_pattern", F.col("ingest_seq") % 7), path, [*files.LEAD_COLUMNS, "slug_pattern"])
    return files.read_csv(spark, path, open_schema=True).select("company_name", "email", "data_quality", "slug_pattern")


def s3_typed_leads(spark, sf_dir):
    """Text decoded to types again."""
    path = folder(spark, "csv")
    files.write_csv(view(spark, sf_dir, "leads"), path)
    t = files.typed(files.read_csv(spark, path))
    return t.select("company_name", "contact_name", "ai_score", "confidence_score", "email_guessed", "date_of_creation", F.size("contact_names").alias("contacts"), F.size("refinement_notes").alias("notes"))


def s4_write_leads_csv(spark, sf_dir):
    """A projection to fixed columns with joined lists."""
    return files.to_text(view(spark, sf_dir, "leads"), COLUMNS)


def s5_checkpoint_leads(spark, sf_dir):
    """Two versions of a table; readers see the second as a whole."""
    root, leads = folder(spark, "table"), view(spark, sf_dir, "leads").select("lead_id", "company_name", "email")
    files.checkpoint(leads, root)
    files.checkpoint(leads.where("email IS NOT NULL"), root)
    return files.current(spark, root)


def s6_append_leads(spark, sf_dir):
    """Two appends."""
    path, leads = folder(spark, "table"), view(spark, sf_dir, "leads").select("lead_id", "category")
    files.append(leads.where("category = 'unit8'"), path)
    files.append(leads.where("category = 'office'"), path)
    return spark.read.parquet(path)


def s7_ingest_registry_companies(spark, sf_dir):
    """Company payloads to rows."""
    item = F.struct(F.col("lead_id").alias("company_number"), F.concat(F.lit("  "), F.col("company_name")).alias("company_name"), F.lit("active").alias("company_status"), F.array(F.lit("70229")).alias("sic_codes"), F.col("date_of_creation").cast("string").alias("date_of_creation"), F.struct(F.lit("").alias("address_line_1"), F.concat(F.lit("Unit "), F.col("ingest_seq").cast("string")).alias("address_line_2"), F.split_part("location", F.lit(","), F.lit(1)).alias("locality"), F.lit("Surrey").alias("region"), F.trim(F.split_part("location", F.lit(","), F.lit(2))).alias("postal_code")).alias("registered_office_address"))
    raw = view(spark, sf_dir, "leads").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))
    return landed.companies(raw).select("company_number", "company_name", "location", "date_of_creation")


#: Positions that one payload of officers covers.
PAYLOAD = 1000


def s8_ingest_officers(spark, sf_dir):
    """Officer payloads of each company to rows."""
    item = F.struct("name", F.col("role").alias("officer_role"), F.col("appointed_on").cast("string").alias("appointed_on"), F.col("resigned_on").cast("string").alias("resigned_on"))
    # pages of a company's officers by ranges of their position (its orders' keys), so that no payload grows with the company
    raw = view(spark, sf_dir, "officers").groupBy("company_number", F.floor(F.col("pos") / PAYLOAD).alias("page")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("payload")).drop("page")
    return landed.officers(raw).select("company_number", "name", "role", "appointed_on", "resigned_on")


def s9_ingest_places(spark, sf_dir):
    """Place payloads to rows; every other display name is an object."""
    name = F.when(F.col("pos") % 2 == 0, F.to_json(F.struct(F.col("display_name").alias("text")))).otherwise(F.to_json(F.struct(F.col("display_name").alias("x"))).substr(F.lit(6), F.length("display_name") + 2))
    body = F.concat(F.lit('{"places":[{"id":"'), F.col("place_id"), F.lit('","displayName":'), name, F.lit(',"internationalPhoneNumber":"+44 1","rating":'), F.col("rating").cast("string"), F.coalesce(F.concat(F.lit(',"userRatingCount":'), F.col("reviews").cast("string")), F.lit("")), F.lit(',"types":'), F.to_json("types"), F.lit("}]}"))
    return landed.places(view(spark, sf_dir, "places").select("town", body.alias("payload"))).select("place_id", "town", "display_name", "phone", "google_rating", "sector")


def s10_ingest_registry_search(spark, sf_dir):
    """Search payloads to rows; dead companies are dropped."""
    status = F.when(F.col("ingest_seq") % 5 == 0, "dissolved").otherwise("active")
    item = F.struct(F.col("company_name").alias("title"), status.alias("company_status"), F.col("lead_id").alias("company_number"), F.when(F.col("ingest_seq") % 2 == 0, F.col("sector")).alias("description"), F.struct(F.split_part("location", F.lit(","), F.lit(1)).alias("locality")).alias("address"))
    raw = view(spark, sf_dir, "leads").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))
    return landed.search(raw)


def x1_incremental_ingest(spark, sf_dir):
    """Leads arriving as files, appended if they share no key with an earlier one that was."""
    base = folder(spark, "stream")
    view(spark, sf_dir, "leads_dup").select("lead_id", "ingest_seq", "company_name", "website", "location", "place_id", "email").write.parquet(f"{base}/in")
    stream = ingest.files(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
    ingest.incremental_ingest(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("lead_id", "ingest_seq", F.expr("lower(trim(company_name))").alias("name"))


def x2_incremental_dedupe(spark, sf_dir):
    """Company numbers once each over a stream of officers."""
    base = folder(spark, "stream")
    view(spark, sf_dir, "officers").select("company_number").write.parquet(f"{base}/in")
    stream = ingest.files(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
    ingest.first_seen(stream, "company_number", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def queries() -> dict:
    own = [s1_read_leads_csv, s2_read_leads_csv_open, s3_typed_leads, s4_write_leads_csv, s5_checkpoint_leads, s6_append_leads, s7_ingest_registry_companies, s8_ingest_officers, s9_ingest_places, s10_ingest_registry_search, x1_incremental_ingest, x2_incremental_dedupe]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    leads, officers, places = (with_views(DUCK, [n]) for n in ("leads", "officers", "places"))
    text = {"ai_score": "coalesce(ai_score::VARCHAR, '')", "email_guessed": "coalesce(email_guessed::VARCHAR, '')", "confidence_score": "coalesce(confidence_score::VARCHAR, '')", "date_of_creation": "date_of_creation::VARCHAR"}
    text |= {c: f"coalesce(array_to_string({c}, '; '), '')" for c in ("enrichment_source", "contact_names", "refinement_notes")}
    flat = "SELECT " + ", ".join(f"{text.get(c, f'''coalesce({c}, '')''')} AS {c}" for c in COLUMNS) + " FROM leads"
    return {
        "s1_read_leads_csv": leads + flat,
        "s2_read_leads_csv_open": leads + "SELECT company_name, coalesce(email, '') AS email, '' AS data_quality, (ingest_seq % 7)::VARCHAR AS slug_pattern FROM leads",
        "s3_typed_leads": leads + "SELECT company_name, CASE WHEN contact_name <> 'nan' THEN contact_name END AS contact_name, ai_score, confidence_score, email_guessed, date_of_creation, len(contact_names)::INT AS contacts, len(refinement_notes)::INT AS notes FROM leads",
        "s4_write_leads_csv": leads + flat,
        "s5_checkpoint_leads": leads + "SELECT lead_id, company_name, email FROM leads WHERE email IS NOT NULL",
        "s6_append_leads": leads + "SELECT lead_id, category FROM leads",
        "s7_ingest_registry_companies": leads + "SELECT lead_id AS company_number, company_name, concat_ws(', ', 'Unit ' || ingest_seq, nullif(split_part(location, ',', 1), ''), 'Surrey', nullif(trim(split_part(location, ',', 2)), '')) AS location, date_of_creation FROM leads",
        "s8_ingest_officers": officers + "SELECT company_number, name, role, appointed_on, resigned_on FROM officers",
        "s9_ingest_places": places + "SELECT place_id, town, display_name, '+44 1' AS phone, rating::VARCHAR || '/5' || coalesce(' (' || reviews || ' reviews)', '') AS google_rating, left(array_to_string(types, ', '), 200) AS sector FROM places",
        "s10_ingest_registry_search": leads + "SELECT lead_id AS company_number, company_name, coalesce(split_part(location, ',', 1), '') AS location, CASE WHEN ingest_seq % 2 = 0 THEN sector ELSE 'active' END AS sector FROM leads WHERE ingest_seq % 5 <> 0",
        "x1_incremental_ingest": with_views(DUCK, ["leads_dup"]) + f"SELECT lead_id, ingest_seq, lower(trim(company_name)) AS name FROM leads_dup WHERE ingest_seq IN (SELECT ingest_seq FROM ({arrivals_sql('leads_dup', keys=ingest_keys)}) k)",
        "x2_incremental_dedupe": officers + "SELECT DISTINCT company_number FROM officers",
    }
