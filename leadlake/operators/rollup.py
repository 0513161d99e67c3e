"""Pages of one host as one record, by aggregates that stay small however many pages a host has."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..functions.emails import found, free_mail, generic
from ..functions.names import contact_valid
from ..sources.store import erase, written
from .core import job

#: Characters of a host's joined text, its contacts, and parts that one merge takes together.
CHARS, CONTACTS, FAN = 5000, 20, 32
#: A name before its role.
NEAR = "([A-Z][a-z]+ [A-Z][a-z]+)(?:,| -| is)? (?:the |our )?(?:[Dd]irector|[Ff]ounder|[Oo]wner|[Pp]artner|[Tt]herapist)"


def leading(pages: Iterable[tuple], most: int) -> list[tuple]:
    """Of (page, text) pairs those, in order, that begin within the first `most` characters of the texts joined by blanks."""
    out, size = [], 0
    for page, text in sorted(pages):
        if size >= most:
            break
        out.append((page, text))
        size += len(text) + 1
    return out


def _by_task(most: int, names: list[str]):
    """Each task's leading pages of each host; what can't be among the host's is dropped on the way."""

    def run(batches):
        hosts: dict = {}
        for batch in batches:
            for host, page, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held = hosts.setdefault(host, [[], 0])
                held[0].append((page, text))
                held[1] += len(text) + 1
                if held[1] > 4 * most:
                    held[0] = leading(held[0], most)
                    held[1] = sum(len(t) + 1 for _, t in held[0])
        rows = [(host, page, text) for host, (pages, _) in hosts.items() for page, text in leading(pages, most)]
        for at in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1000], strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names)

    return run


def first_text(pages: DataFrame, most: int = CHARS, fan: int = FAN) -> DataFrame:
    """host and the first `most` characters of its pages' texts, joined by blanks in the order of page_id.

    Tasks keep the leading pages of each host before anything is shuffled; then
    `fan` tasks' pages are merged, and so on in levels until one part is left, so
    no task ever gets more than `fan` times a little over `most` characters of a
    host.  Null texts are left out; a host with none has no row.
    """
    rows = pages.select("host", F.col("page_id").cast("long").alias("page_id"), F.substring("text", 1, most).alias("text")).where("text IS NOT NULL")
    names = ["host", "page_id", "text"]
    level = written(rows.mapInArrow(_by_task(most, names), "host string, page_id long, text string").withColumn("part", F.spark_partition_id()), "leading")
    parts = (level.agg(F.max("part")).first()[0] or 0) + 1
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("host", "part").orderBy("page_id", "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    while parts > fan:
        merged = level.withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        last, level = level, written(merged.withColumn("before", before).where(F.col("before") < most).drop("before"), "leading")
        erase(last)
        parts = -(-parts // fan)
    last = level.withColumn("part", F.lit(0)).withColumn("before", before).where(F.col("before") < most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "text"))), lambda x: x["text"]), " ")
    return last.groupBy("host").agg(F.substring(joined, 1, most).alias("text"))


def _mails(d, table: str = "page_text") -> str:
    """Each address of a host with its kind (1 personal, 2 free mail, 3 shared) and its first page."""
    rank = f"CASE WHEN {generic(d, 'email')} THEN 3 WHEN {free_mail(d, 'email')} THEN 2 ELSE 1 END"
    return f"SELECT host, email, {rank} AS kind, min(page_id) AS page_id FROM (SELECT host, page_id, {d.explode(found(d, 'text'))} AS email FROM {table}) a GROUP BY host, email"


def _names(d, table: str = "page_text") -> str:
    """Each valid name before a role of a host with its first page."""
    return f"SELECT host, name, min(page_id) AS page_id FROM (SELECT host, page_id, {d.explode(d.extract_all('text', NEAR, 1))} AS name FROM {table}) a WHERE {contact_valid(d, 'name')} GROUP BY host, name"


def _plain(d) -> str:
    return f"""SELECT t.host, t.pages, m.email, coalesce(m.emails, 0) AS emails, m.known, n.contacts, t.text FROM (SELECT host, count(*) AS pages, left(string_agg(left(text, {CHARS}), ' ' ORDER BY page_id), {CHARS}) AS text FROM page_text GROUP BY host) t
        LEFT JOIN (SELECT host, email, n AS emails, CASE WHEN kind = 1 THEN lower(email) END AS known FROM (SELECT host, email, kind, row_number() OVER (PARTITION BY host ORDER BY kind, page_id, email) AS place, count(*) OVER (PARTITION BY host) AS n FROM ({_mails(d)}) x) y WHERE place = 1) m ON m.host IS NOT DISTINCT FROM t.host
        LEFT JOIN (SELECT host, string_agg(name, '; ' ORDER BY page_id, name) AS contacts FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, name) AS place FROM ({_names(d)}) x) y WHERE place <= {CONTACTS} GROUP BY host) n ON n.host IS NOT DISTINCT FROM t.host"""


@job("A18", "page_text", plain=_plain)
def page_contact_rollup(page_text: DataFrame, most_chars: int = CHARS, most_contacts: int = CONTACTS) -> DataFrame:
    """Pages of one host as one record: number of pages, the best address (personal, then free mail, then shared; then by page and spelling), number of different addresses, the known personal form, up to twenty contacts by page, and the first characters of the joined text. A null host is one of its own."""
    from .core import query

    pages = page_text.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    mails = query(_mails(SPARK), page_text=page_text).groupBy("host").agg(F.min(F.struct("kind", "page_id", "email")).alias("best"), F.count(F.lit(1)).alias("emails"))
    place = F.row_number().over(Window.partitionBy("host").orderBy("page_id", "name"))
    names = query(_names(SPARK), page_text=page_text).withColumn("place", place).where(F.col("place") <= most_contacts)
    names = names.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), "; ").alias("contacts"))
    out = pages
    for side in (mails, names, first_text(page_text, most_chars)):
        own = side.withColumnRenamed("host", "own_host")
        out = out.join(own, F.col("host").eqNullSafe(F.col("own_host")), "left").drop("own_host")
    known = F.when(F.col("best.kind") == 1, F.lower("best.email"))
    return out.select("host", "pages", F.col("best.email").alias("email"), F.coalesce("emails", F.lit(0)).alias("emails"), known.alias("known"), "contacts", "text")
