"""Packing of documents into fixed-length sequences by first-fit decreasing.

Each document's ids (end id included) are cut into pieces of at most
`piece_tokens`; pieces are dealt into randomised groups of bounded expected size
by a hash, and every group is packed on its own: pieces in falling length, each
into the first open sequence with room, found by descending a tournament tree
that holds the largest room below every node.

Null text counts as empty: one piece with the end id alone.  Repeated rows are
packed once each.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken, sampling
from .store import written
from .text import parts

#: Expected pieces of one group, and of documents behind the first-tier table.
GROUP_PIECES, SAMPLE_DOCS, TABLE_ENTRIES = 4096, 1500, 65_536
NUMBERS = ["start", "length", "ids_crc32", "doc_tokens"]


class Rooms:
    """Tournament tree over sequences in order of opening: each node holds the largest room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """First sequence with room for `size`; the room is used up by it."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        found = node - self.leaves
        tree[node] -= size
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a > b else b
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; equal sizes keep their order."""
    rooms = Rooms(len(sizes), capacity)
    seq, offset, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        b = rooms.take(n)
        seq[i], offset[i] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + n
    return seq, offset


def encode_batch(texts: list[str | None], path: str, table: pretoken.Table = pretoken.NO_TABLE) -> list[np.ndarray]:
    """Ids of each text as the library gives them."""
    if not pretoken.is_plain_byte_bpe(path):
        whole = pretoken.tokenizer(path)
        return [np.array(whole.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts]
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for i, _, ids in pretoken.encoded(texts, path, table, True):
        out[i].append(ids)
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def pieces(docs: DataFrame, path: str, piece_tokens: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every document, and deal: the piece's number in its task, mixed with the task's."""
    table = pretoken.NO_TABLE
    if pretoken.is_plain_byte_bpe(path):
        some = sampling.fetch(docs, sampling.by_hash(docs, doc_id, SAMPLE_DOCS), doc_id, [text], 20_000)
        table = pretoken.frequent(some[text].tolist(), path, TABLE_ENTRIES, True)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().alias("task"))
    kind = dict(rows.dtypes)["doc_id"]
    last = np.array([end_id], np.uint32)

    def cut(batches):
        met = 0
        for b in batches:
            for run, texts in parts(b, 1):
                row, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(encode_batch(texts, path, shared.value)):
                    ids = np.concatenate([ids, last]).astype("<u4")
                    for s in range(0, len(ids), piece_tokens):
                        own = ids[s : s + piece_tokens]
                        row.append(i)
                        start.append(s)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        total.append(len(ids))
                deal = pc.add(pc.multiply(run.column(2).cast(pa.int64()).take(pa.array(row, pa.int64())), 1 << 32), pa.array(range(met, met + len(row)), pa.int64()))
                met += len(row)
                yield pa.RecordBatch.from_arrays([run.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), deal], ["doc_id", *NUMBERS, "deal"])

    return rows.mapInArrow(cut, f"doc_id {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, deal long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, piece_tokens: int | None = None, end_id: int = 1, seed: int = 0, doc_id: str = "doc_id", text: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    sequence_id is group * 2^32 + place in the group.  The number of groups
    follows the number of pieces, and pieces are dealt by a hash of their place
    in the input, so a group stays bounded at any size and however many rows are alike.
    """
    cut = written(pieces(docs, path, piece_tokens or capacity, end_id, doc_id, text), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("deal", F.lit(seed)), F.lit(groups))).drop("deal")
    kind = dict(cut.dtypes)["doc_id"]

    def one(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        seq, offset = first_fit_decreasing(own["length"].to_numpy(), capacity)
        own["sequence_id"] = int(key[0]) * 2**32 + seq
        own["offset"] = offset
        return own.drop(columns="pack_group")

    return dealt.groupBy("pack_group").applyInPandas(one, f"doc_id {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, sequence_id long, offset long")
