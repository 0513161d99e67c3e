"""Lead tables as CSV and Parquet: typed reading, fixed projections, all-or-nothing replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a lead file, in order. (Fixed values.)
LEAD_COLUMNS = [
    "company_name", "website", "sector", "contact_name", "email", "linkedin", "location", "employee_count", "source", "ai_score", "ai_reason", "tag",
    "phone", "google_rating", "place_id", "search_town", "category", "enrichment_source", "enrichment_status", "ai_enriched", "email_guessed", "contact_verified",
    "generic_email", "contact_names", "personal_email_guesses", "contact_titles", "multiple_contacts", "principal_name", "principal_email_guess", "facebook_url",
    "contact_email", "team_email_guesses", "email_type", "name_review_needed", "missing_email", "website_verified", "data_score", "enrichment_attempts",
    "confidence_score", "refinement_notes", "contact_source", "last_enriched_date", "mailshot_category", "missing_name_final", "data_quality", "geo_relevance",
    "date_of_creation", "size_signal",
]
INTEGERS = ["ai_score", "enrichment_attempts", "employee_count"]
FLAGS = ["email_guessed", "contact_verified", "ai_enriched", "multiple_contacts", "missing_email", "name_review_needed", "missing_name_final", "archived"]
DATES = ["date_of_creation", "last_enriched_date"]
LISTS = ["contact_names", "contact_titles", "personal_email_guesses", "team_email_guesses", "refinement_notes", "enrichment_source"]


def read_csv(spark: SparkSession, path: str, open_schema: bool = False) -> DataFrame:
    """All-text rows with every lead column; missing ones are empty. Unknown columns are dropped, or kept with `open_schema`. No file, no rows."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath) is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in LEAD_COLUMNS))
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in LEAD_COLUMNS]
    extra = [F.col(f"`{c}`") for c in raw.columns if c not in LEAD_COLUMNS] if open_schema else []
    return raw.select(*cols, *extra)


def typed(leads: DataFrame) -> DataFrame:
    """Text columns decoded: blanks, `nan` and `None` to null; numbers, flags, dates, lists and ratings to their types."""
    clean = lambda c: F.when(F.lower(F.trim(c)).isin("", "nan", "none"), None).otherwise(F.trim(c))
    out = []
    for c in leads.columns:
        v = clean(F.col(f"`{c}`"))
        if c in INTEGERS:
            v = v.try_cast("int")
        elif c == "confidence_score":
            v = v.try_cast("double")
        elif c in FLAGS:
            v = F.when(F.lower(v) == "true", True).when(F.lower(v) == "false", False)
        elif c in DATES:
            v = v.try_cast("date")
        elif c in LISTS:
            v = F.filter(F.split(F.coalesce(v, F.lit("")), r"\s*[;|]\s*"), lambda x: x != "")
        elif c == "google_rating":
            number = lambda p: F.nullif(F.regexp_extract(v, p, 1), F.lit(""))  # noqa: E731, B023
            v = F.struct(number(r"^([0-9.]+)/5").try_cast("double").alias("rating"), number(r"\((\d+) reviews").try_cast("int").alias("reviews"))
        out.append(v.alias(c))
    return leads.select(*out)


def to_text(leads: DataFrame, columns: list[str]) -> DataFrame:
    """A fixed ordered list of columns as text; lists are joined with `; `."""
    kind = dict(leads.dtypes)
    one = lambda c: F.array_join(c, "; ") if kind[c].startswith("array") else F.col(c).cast("string")
    return leads.select(*(F.coalesce(one(c), F.lit("")).alias(c) if c in kind else F.lit("").alias(c) for c in columns))


def write_csv(leads: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    to_text(leads, columns or LEAD_COLUMNS).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="")


def append(leads: DataFrame, path: str) -> None:
    leads.write.mode("append").parquet(path)


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions of the table at `root`, oldest first; a version is complete once its success mark is there."""
    fs = spark._jvm.org.apache.hadoop.fs
    found = fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs.Path(f"{root}/v-*/_SUCCESS"))
    return sorted(s.getPath().getParent().getName() for s in found or [])


def checkpoint(leads: DataFrame, root: str) -> str:
    """Replaces the table at `root` as a whole: a new numbered version is written, and readers take the highest complete one.

    Nothing is renamed or deleted, so a reader always finds a whole table, on object stores too.
    """
    spark = leads.sparkSession
    held = _versions(spark, root)
    version = f"v-{int(held[-1].split('-')[1]) + 1 if held else 1:012}-{uuid.uuid4().hex}"
    leads.write.parquet(f"{root}/{version}")
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{_versions(spark, root)[-1]}")
