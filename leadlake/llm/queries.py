"""The registered queries of the training-data operators; each applies one operator to its whole table."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Label ids up to which they are broadcast (about 30 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train
    from .sampling import remainder

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels, remainder("doc_id", 5) == 0)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sampling import remainder
    from .toxicity import score, train

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels, remainder("doc_id", 5) == 0)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality; background: all documents."""
    from .lm import score

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    if good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    marked = docs.join(good, "doc_id", "left")
    return score(marked, F.col("good"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train
    from .sampling import remainder

    docs = read(spark, sf_dir, "documents")
    model = train(docs, F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import neighbours

    return neighbours(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a tenth of the documents, by a hash of the id, repeat from some place on."""
    from .runs import periodic_runs

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    row = F.col("row")

    def repeated(words):
        a = F.pmod(row["g"], F.size(words))
        p = F.lit(1) + F.floor((F.size(words) - a) / (F.lit(3) + row["g"] % 8))
        each = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        return F.when(F.size(words) > 0, F.array_join(each, " "))

    # the words stand as a lambda's variable, so that they are split once
    words = F.filter(F.split(row["text"], r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(row["h"] % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(row["text"])
    docs = docs.select("doc_id", F.struct("text", h.alias("h"), g.alias("g")).alias("row")).select("doc_id", text.alias("text"))
    found = periodic_runs(docs)
    kind = "struct<start:long,length:long,period:long>"
    best = F.aggregate("runs", F.lit(None).cast(kind), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(read(spark, sf_dir, "documents")).drop("k")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files of both versions, converted to WARC, read back."""
    from .store import place
    from .warc import convert, read_warc, write_arc

    arc, warc = place(spark, "arc"), place(spark, "warc")
    write_arc(read(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    back = read_warc(spark, warc).where("record_type IN ('response', 'revisit')")
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").cast("long").alias("refers_to"))


#: Base32 of SHA-1: each five hexadecimal digits are four characters.
OP13_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    h AS (SELECT page_id, payload, octet_length(encode(payload)) AS n, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS least,
                 row_number() OVER (PARTITION BY payload ORDER BY page_id) AS nth FROM p)
    SELECT page_id, n::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
           CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN least END AS refers_to FROM h"""


OP9_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 10"""


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_toxicity": op2_toxicity,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_language_id": op4_language_id,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_fingerprints": op6_fingerprints,
        "op7_packing": op7_packing,
        "op8_token_counts": op8_token_counts,
        "op9_topk_search": op9_topk_search,
        "op10_mixing": op10_mixing,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_phrase_mining": op12_phrase_mining,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    from . import mixing, phrases

    return {"op9_topk_search": OP9_SQL, "op10_mixing": mixing.sql(), "op12_phrase_mining": phrases.sql(), "op13_warc": OP13_SQL}
