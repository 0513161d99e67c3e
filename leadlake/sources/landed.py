"""Landed JSON of registries and place searches as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPANIES = "items ARRAY<STRUCT<company_number STRING, company_name STRING, company_status STRING, sic_codes ARRAY<STRING>, date_of_creation STRING, registered_office_address STRUCT<address_line_1: STRING, address_line_2: STRING, locality: STRING, region: STRING, postal_code: STRING>>>"
OFFICERS = "items ARRAY<STRUCT<name STRING, officer_role STRING, appointed_on STRING, resigned_on STRING>>"
PLACES = "places ARRAY<STRUCT<id STRING, displayName STRING, formattedAddress STRING, websiteUri STRING, nationalPhoneNumber STRING, internationalPhoneNumber STRING, rating DOUBLE, userRatingCount INT, types ARRAY<STRING>, businessStatus STRING>>"
SEARCH = "items ARRAY<STRUCT<title STRING, company_status STRING, company_number STRING, description STRING, snippet STRING, address STRUCT<locality: STRING, postal_code: STRING>>>"
#: fixed values: statuses of companies that no longer trade
DEAD = ["dissolved", "liquidation", "converted-closed"]


def items(raw: DataFrame, schema: str, field: str, keep: list[str]) -> DataFrame:
    """One row for each element of the payload's array; broken payloads give none."""
    parsed = raw.withColumn("parsed", F.from_json("payload", schema.replace("STRUCT<", "STRUCT<")))
    return parsed.select(*keep, F.posexplode(f"parsed.{field}").alias("pos", "x")).select(*keep, "pos", "x.*")


def _squeezed(c: str):
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def companies(raw: DataFrame) -> DataFrame:
    """Registry companies; rows without a name are dropped."""
    out = items(raw, COMPANIES, "items", [])
    place = F.concat_ws(", ", *(F.nullif(F.trim(f"registered_office_address.{p}"), F.lit("")) for p in ("address_line_1", "address_line_2", "locality", "region", "postal_code")))
    return out.select("company_number", _squeezed("company_name").alias("company_name"), "company_status", "sic_codes", F.col("date_of_creation").try_cast("date").alias("date_of_creation"), place.alias("location")).where("company_name <> ''")


def officers(raw: DataFrame) -> DataFrame:
    """Officers (or persons with control) of each company."""
    out = items(raw, OFFICERS, "items", ["company_number"])
    return out.select("company_number", "pos", "name", F.col("officer_role").alias("role"), F.col("appointed_on").try_cast("date").alias("appointed_on"), F.col("resigned_on").try_cast("date").alias("resigned_on"))


def places(raw: DataFrame) -> DataFrame:
    """Places; the display name is an object with a text or plain text; the national phone number goes first."""
    out = items(raw, PLACES, "places", ["town"])
    name = F.coalesce(F.get_json_object("displayName", "$.text"), F.col("displayName"))
    rating = F.when(F.col("rating").isNotNull(), F.concat(F.col("rating").cast("string"), F.lit("/5"), F.coalesce(F.format_string(" (%d reviews)", "userRatingCount"), F.lit(""))))
    rating = F.when(F.col("userRatingCount").isNull(), F.concat(F.col("rating").cast("string"), F.lit("/5"))).otherwise(rating)
    return out.select(F.col("id").alias("place_id"), "town", name.alias("display_name"), F.coalesce("nationalPhoneNumber", "internationalPhoneNumber").alias("phone"), rating.alias("google_rating"), F.left(F.array_join("types", ", "), F.lit(200)).alias("sector")).where("display_name <> ''")


def search(raw: DataFrame) -> DataFrame:
    """Registry search results that still trade; sector is the description, else the snippet, else the status."""
    out = items(raw, SEARCH, "items", [])
    place = F.concat_ws(", ", F.nullif(F.col("address.locality"), F.lit("")), F.nullif(F.col("address.postal_code"), F.lit("")))
    return out.where(~F.lower(F.coalesce("company_status", F.lit(""))).isin(DEAD)).select("company_number", F.col("title").alias("company_name"), place.alias("location"), F.coalesce("description", "snippet", "company_status").alias("sector"))
