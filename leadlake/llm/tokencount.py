"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of frequent pre-tokens (characters, id count)
taken from a bounded sample of documents and broadcast; it decides only speed.
Tier two is a cache inside each Python worker: pre-tokens that tier one lacks
are encoded once per worker.  No pre-token is ever shuffled.

Null text counts as empty (0 bytes, 0 tokens).  Repeated rows and null ids give
one result row each; other columns of the input are ignored, an empty table gives
no rows.  A vocabulary that is not plain byte-level BPE is encoded by its
library, text by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken, sampling
from .text import parts

#: Bounds of the broadcast table: sampled documents, entries (about 20 bytes each).
SAMPLE_DOCS, TABLE_ENTRIES = 1500, 65_536


def count_batch(texts: list[str | None], path: str, table: pretoken.Table = pretoken.NO_TABLE) -> np.ndarray:
    """Ids of each text, as the library counts them."""
    if path.endswith(".model"):
        model = pretoken.sentence_model(path)
        return np.array([len(model.encode(t or "")) for t in texts], np.int64)
    if not pretoken.is_plain_byte_bpe(path):
        whole = pretoken.tokenizer(path)
        return np.array([len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts], np.int64)
    out = np.zeros(len(texts), np.int64)
    for i, n, _ in pretoken.encoded(texts, path, table, False):
        out[i] += n
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    spark = docs.sparkSession
    frequent = pretoken.NO_TABLE
    if pretoken.is_plain_byte_bpe(path):
        some = sampling.fetch(docs, sampling.by_hash(docs, doc_id, sample_docs), doc_id, [text], 20_000)
        frequent = pretoken.frequent(some[text].tolist(), path, entries, False)
    table = spark.sparkContext.broadcast(frequent)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def count(batches):
        for b in batches:
            for run, texts in parts(b, 2):
                n = count_batch(texts, path, table.value)
                yield pa.RecordBatch.from_arrays([run.column(0), run.column(1), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
