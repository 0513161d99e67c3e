"""Context-triggered piecewise hashes and their likeness.

A rolling hash of the last eight bytes marks chunk ends wherever it has at least
k trailing zero bits, so an edit moves only the ends near it.  k is the least
level (2 or more) with under 64 ends; the fingerprint is `k:a:b`, where each
chunk at level k gives one character of a, and at level k+1 one of b.  Two
fingerprints compare where their levels meet: equal levels by the better of
both parts, neighbouring levels by the part they share, others are unlike (0).
Likeness is 1 - d / (m + n) for the insert-delete edit distance d of two parts
of m and n characters, and 0 unless they share a run of `RUN` characters (a
shorter part must be equal).

A null text counts as empty; its fingerprint is `2::`.  Equal texts have equal
fingerprints.  `neighbours` orders rows by id, nulls first, repeated ids by a
hash of their text; the last row's neighbour is the first row.  A single row is
its own neighbour, an empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .text import mix, parts, slices

LEVEL, ENDS, RUN, PAD = 2, 64, 4, 8
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BYTES = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _rolling(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixed rolling hash of every byte, with `PAD` blank places before each text; where texts begin and end."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    end = np.cumsum(size + PAD)
    begin = end - size
    gap = b"\0" * PAD
    h = _BYTES[np.frombuffer(gap + gap.join(raw), np.uint8)]
    blank = begin[:, None] - np.arange(1, PAD + 1)
    h[blank.ravel()] = 0
    m = 0x01000193
    for shift in (1, 2, 4):
        h[shift:] += h[:-shift] * np.uint32(m)
        m = m * m & 0xFFFFFFFF
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return h, begin, end


def _parts(h: np.ndarray, sums: np.ndarray, at: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[str]:
    """One character for each chunk; `at` holds the last byte of each marked chunk."""
    n = len(begin)
    close = np.concatenate([at + 1, end])  # the rest of each text is its last chunk
    owner = np.concatenate([doc, np.arange(n)])
    order = np.lexsort((close, owner))
    close, owner = close[order], owner[order]
    start = np.concatenate([[0], close[:-1]])
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    start[first] = begin[owner[first]]
    full = close > start
    close, start, owner = close[full], start[full], owner[full]
    chars = ALPHABET[(mix(sums[close] - sums[start] + (close - start).astype(np.uint64)) & np.uint64(63)).astype(np.int64)].tobytes().decode()
    cut = np.searchsorted(owner, np.arange(n + 1)).tolist()
    return [chars[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each whole text."""
    out: list[str] = []
    for _, part in slices(texts):
        h, begin, end = _rolling(part)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h, dtype=np.uint64, out=sums[1:])
        mark = np.flatnonzero((h & np.uint32((1 << LEVEL) - 1)) == 0)
        doc = np.searchsorted(begin, mark, side="right") - 1
        inside = (doc >= 0) & (mark < end[doc])
        mark, doc = mark[inside], doc[inside]
        low = h[mark]
        zeros = np.where(low == 0, 32, np.bitwise_count((low & (~low + np.uint32(1))) - np.uint32(1))).astype(np.int64)
        table = np.bincount(doc * 33 + zeros, minlength=33 * len(part)).reshape(len(part), 33)
        ends = table[:, ::-1].cumsum(axis=1)[:, ::-1]  # ends at each level or above
        level = np.minimum(LEVEL + (ends[:, LEVEL:] >= ENDS).sum(axis=1), 31)
        a = zeros >= level[doc]
        b = zeros >= level[doc] + 1
        one = _parts(h, sums, mark[a], doc[a], begin, end)
        two = _parts(h, sums, mark[b], doc[b], begin, end)
        out += [f"{k}:{x}:{y}" for k, x, y in zip(level.tolist(), one, two, strict=True)]
    return out


def _grid(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(parts), 64), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer("".join(parts).encode(), np.uint8)
    out[np.arange(64) < size[:, None]] = flat
    return out, size


def part_likeness(xs: list[str], ys: list[str], run: int = RUN) -> np.ndarray:
    """Likeness of signature parts (at most 64 characters each), pair by pair, with bit-parallel common subsequences."""
    out = np.zeros(len(xs))
    for at in range(0, len(xs), 2048):
        x, nx = _grid(xs[at : at + 2048])
        y, ny = _grid(ys[at : at + 2048])
        ends = np.full(len(x), ~np.uint64(0))
        valid = np.arange(64) < nx[:, None]
        for j in range(int(ny.max(initial=0))):
            match = np.packbits((x == y[:, j : j + 1]) & valid & (j < ny)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            u = ends & match
            ends = (ends + u) | (ends - u)
        common = np.bitwise_count(~ends).astype(np.int64)
        gram = lambda g: sum(g[:, i : 64 - run + 1 + i].astype(np.uint32) << np.uint32(8 * i) for i in range(run))
        gx, gy = gram(x), gram(y)
        gx[np.arange(gx.shape[1]) > (nx - run)[:, None]] = 1
        gy[np.arange(gy.shape[1]) > (ny - run)[:, None]] = 2
        shared = np.zeros(len(x), bool)
        for j in range(gy.shape[1]):
            shared |= (gx == gy[:, j : j + 1]).any(axis=1)
        same = (nx == ny) & (x == y).all(axis=1)
        total = np.maximum(nx + ny, 1)
        out[at : at + 2048] = np.where(same, 1.0, np.where(shared, 2.0 * common / total, 0.0))
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    xs, ys, where = [], [], []
    out = np.zeros(len(left))
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if a == b:
            out[i] = 1.0
            continue
        ka, a1, a2 = a.split(":")
        kb, b1, b2 = b.split(":")
        d = int(ka) - int(kb)
        for x, y in {0: ((a1, b1), (a2, b2)), 1: ((a1, b2),), -1: ((a2, b1),)}.get(d, ()):
            if x and y:
                xs.append(x)
                ys.append(y)
                where.append(i)
    if xs:
        np.maximum.at(out, np.array(where), part_likeness(xs, ys))
    return out


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of what follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: pa.Array, texts: list[str], marks: list[str], following: list[str], next_marks: list[str]) -> list[pa.Array]:
    changed = [edit(t, f) for t, f in zip(texts, following, strict=True)]
    sha = [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]
    edited = fingerprints(changed)
    return [ids, pa.array(map(len, texts), pa.int64()), pa.array(sha, pa.string()), pa.array(marks, pa.string()), pa.array(edited, pa.string()), pa.array(likeness(marks, edited), pa.float64()), pa.array(likeness(marks, next_marks), pa.float64())]


OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
EDGE = ["task", "last_text", "last_hash", "first_id", "first_hash", "first_text", "first_mark"]


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next one, and their likenesses.

    Rows are range-partitioned and sorted by id once; a task streams through its
    rows with the one before in hand.  The last row of each task meets the first
    of the following task in a small second step: tasks are put in order by ids
    and hashes alone, then joined by number, so no task holds the texts of many.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash", "text")
    kind = dict(rows.dtypes)["doc_id"]
    out = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    edge = f"task long, last_text string, last_hash long, first_id {kind}, first_hash long, first_text string, first_mark string"
    id_type = next(f.dataType for f in rows.schema if f.name == "doc_id")

    def stream(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(id_type)
        kinds = [pa.int64(), pa.string(), pa.int64(), arrow, pa.int64(), pa.string(), pa.string()]
        names = OUT + EDGE
        first = held = None
        for batch in batches:
            for b, texts in parts(batch, 1):
                ids, hashes = b.column(0).cast(arrow), b.column(2)
                marks = fingerprints(texts)
                if first is None:
                    task = b.column(3)[0].as_py()
                    first = (ids[0].as_py(), hashes[0].as_py(), texts[0], marks[0])
                if held is not None:
                    ids, texts, marks = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *marks]
                if len(texts) > 1:
                    yield pa.RecordBatch.from_arrays([*_rows(ids[:-1], texts[:-1], marks[:-1], texts[1:], marks[1:]), *(pa.nulls(len(texts) - 1, t) for t in kinds)], names)
                held = (ids[-1:], texts[-1], marks[-1], hashes[-1].as_py())
        if held is not None:
            last = [held[0], pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([held[2]], pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
            yield pa.RecordBatch.from_arrays([*last, *(pa.array([v], t) for v, t in zip((task, held[1], held[3], *first), kinds, strict=True))], names)

    numbered = ordered.withColumn("task", F.spark_partition_id().cast("long"))
    done = written(numbered.mapInArrow(stream, f"{out}, {edge}"), "fingerprints")
    edges = done.where("task IS NOT NULL")
    along = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash", F.col("doc_id").asc_nulls_first(), "last_hash", "task")
    order = edges.select("task", "first_id", "first_hash", "doc_id", "last_hash").select("task", F.coalesce(F.lead("task").over(along), F.first("task").over(along)).alias("next"))
    following = edges.select(F.col("task").alias("next"), F.col("first_text").alias("t"), F.col("first_mark").alias("m"))
    linked = edges.select("task", "doc_id", "last_text", "fingerprint").join(order, "task").join(following, "next").select("doc_id", "last_text", "fingerprint", "t", "m")

    def close(batches):
        for batch in batches:
            for b, texts in parts(batch, 1):
                yield pa.RecordBatch.from_arrays(_rows(b.column(0), texts, *(b.column(i).to_pylist() for i in (2, 3, 4))), OUT)

    return done.where("task IS NULL").select(*OUT).unionByName(linked.mapInArrow(close, out))
