"""Near-duplicate documents by BagMinHash over weighted five-word shingles.

Signatures.  A shingle that occurs w times weighs w.  Its weight range is cut
into the intervals [0, 1), [1, 2), [2, 4), [4, 8) ...; each interval carries an
independent Poisson process seeded by shingle and interval, whose rate is the
interval's width and whose points also draw a weight level and one of
`COMPONENTS` signature components.  Points whose level lies under w count (for
whole intervals all do, so only the last one is thinned), and the earliest time
seen by a component is its signature value: two documents agree in a component
with the probability of their weighted Jaccard similarity.  A document's points
are only drawn up to a time by which its components are almost surely filled,
and further only if one is not.

Search.  Equal multisets are one content.  Contents that share a band of
`ROWS` components form a bucket; each member is compared exactly with the
bucket's leader, and verified links are merged to components.  What is left to
compare - members of different components, the leader apart - is compared
exactly in blocks of at most `BLOCK` expected members, without a cap: a block
pair returns at most a spanning forest of its links.  No link between contents
that share a band is lost, and none is formed without exact verification.

A null text, or one without any character, is its own class.  A text without
words is compared as one shingle, its whole self.  Rows with a null id take part;
the class id is the least non-null id.  Repeated rows are one class; `keep_one`
keeps one of them.  Ties of the least id fall to the least row hash.  An empty
table gives no rows; further columns are kept by `keep_one`, whatever their names,
and ignored else.  Contents and rows are told apart by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import erase, written
from .text import RunHasher, code_points, mix, parts, shingles, uniform, words

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
BLOCK = 256
_TURN, _SECOND, _THIRD = np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def bags(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, times, text index), ordered by text and shingle."""
    h, doc, *_ = words(texts)
    s, d = shingles(h, doc, len(texts), k)
    bare = np.setdiff1d(np.flatnonzero(np.fromiter(map(len, texts), np.int64, len(texts))), d)
    if len(bare):
        cp, at = code_points([texts[i] for i in bare])
        s = np.concatenate([s, RunHasher(cp)(at[:-1], at[1:])])
        d = np.concatenate([d, bare])
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))), d[at]


def signatures(key: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int, components: int = COMPONENTS) -> np.ndarray:
    """Earliest time of each component (n documents by components); without shingles all are infinite."""
    out = np.full(n * components, np.inf)
    total = np.bincount(doc, weight, n)
    parts = [(key, weight, doc, np.zeros(len(key), np.int64), np.ones(len(key), np.int64))]
    low = 1
    heavy = np.flatnonzero(weight > 1)
    while len(heavy):
        parts.append((mix(key[heavy] + np.uint64(low)), weight[heavy], doc[heavy], np.full(len(heavy), low), np.full(len(heavy), low)))
        low *= 2
        heavy = heavy[weight[heavy] > low]
    key, weight, doc, low, width = map(np.concatenate, zip(*parts, strict=True))
    limit = components * (np.log(components) + 4.0) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[doc])
        seed, time = key[live], np.zeros(len(live))
        while len(live):
            seed = mix(seed + _TURN)
            time = time - np.log(uniform(seed)) / width[live]
            near = time <= limit[doc[live]]
            live, seed, time = live[near], seed[near], time[near]
            draw = mix(seed + _SECOND)
            level = low[live] + ((draw >> np.uint64(32)) % width[live].astype(np.uint64)).astype(np.int64)
            hit = level < weight[live]
            place = doc[live] * components + (draw % np.uint64(components)).astype(np.int64)
            np.minimum.at(out, place[hit], time[hit])
        todo &= np.isinf(out.reshape(n, components)).any(axis=1)
        limit = np.where(todo, limit * 2, limit)
    return out.reshape(n, components)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of each signature."""
    n = len(signature)
    rows = signature.shape[1] // bands
    bits = mix(signature[:, : bands * rows].copy().view(np.uint64)).reshape(n, bands, rows)
    out = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
    for r in range(rows):
        out = mix(out * np.uint64(31) + bits[:, :, r])
    return out


def contents(key: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """128 bits that tell each text's whole multiset from others, as 16 bytes."""
    out = np.zeros((n, 2), np.uint64)
    for side, turn in enumerate((_SECOND, _THIRD)):
        np.add.at(out[:, side], doc, mix(mix(key + turn) + weight.astype(np.uint64) * turn))
    return out


def _binary(rows: np.ndarray, some: np.ndarray | None = None) -> pa.Array:
    """Rows of two 64-bit numbers as binary values; null where not `some`."""
    values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())
    return values if some is None else pc.if_else(pa.array(some), values, pa.scalar(None, pa.binary()))


def signed(rows: DataFrame) -> DataFrame:
    """own_row, doc_id, content, bands of (own_row, doc_id, text) rows; content and bands are null without shingles."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            for part, texts in parts(b, 2):
                key, weight, doc = bags(texts)
                some = np.bincount(doc, minlength=len(texts)) > 0
                keys = band_keys(signatures(key, weight, doc, len(texts))).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(keys[some].ravel()), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binary(contents(key, weight, doc, len(texts)), some), bands], ["own_row", "doc_id", "content", "bands"])

    return rows.mapInArrow(run, f"own_row binary, doc_id {kind}, content binary, bands array<bigint>")


def expanded(rows: DataFrame) -> DataFrame:
    """content, weight, items of (text) rows: each occurrence of a shingle is an item of its own."""

    def run(batches):
        for b in batches:
            for _, texts in parts(b, 0):
                key, times, doc = bags(texts)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                item = mix(np.repeat(key, times) + nth.astype(np.uint64) * _TURN).view(np.int64)
                size = np.bincount(doc, times, len(texts)).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_binary(contents(key, times, doc, len(texts))), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(item))], ["content", "weight", "items"])

    return rows.mapInArrow(run, "content binary, weight long, items array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the links (a, b); the root is the least node that can be reached."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    held = label
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = written(step.join(up, "root").select("node", "was", F.least("root", "above").alias("root")), "roots")
        erase(held)
        held, label = step, step.select("node", "root")
        if step.where("was <> root").isEmpty():
            erase(both)
            return label


def _forest(rows: pd.DataFrame, similar: float) -> pd.DataFrame:
    """Links that join different components, at most a spanning forest, of all pairs of the rows."""
    rows = rows.drop_duplicates("content").sort_values("content", ignore_index=True)
    n = len(rows)
    size = rows["items"].map(len).to_numpy()
    at = np.cumsum(size) - size
    _, code = np.unique(np.concatenate(rows["items"].to_list()), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    first: dict = {}
    root = np.array([first.setdefault(c, i) for i, c in enumerate(rows["comp"])])
    mark = np.zeros(code.max() + 1, bool)
    name = rows["content"].to_numpy()
    out = []
    for i in range(n):
        other = root != root[i]
        other[: i + 1] = False
        other &= (np.minimum(size, size[i]) >= similar * np.maximum(size, size[i]) - 1e-9)
        if not other.any():
            continue
        own = code[at[i] : at[i] + size[i]]
        mark[own] = True
        use = other[owner]
        common = np.bincount(owner[use], mark[code[use]], n)
        mark[own] = False
        for j in np.flatnonzero(other & (common >= similar * (size + size[i] - common) - 1e-9)).tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((name[i], name[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=object)


def _similar(x: str, y: str, similar: float):
    common = F.size(F.array_intersect(f"{x}.items", f"{y}.items"))
    total = F.col(f"{x}.weight") + F.col(f"{y}.weight")
    return common >= F.lit(similar) * (total - common) - F.lit(1e-9)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """own_row, doc_id, content, root of every row of `docs`; rows of one root are one class (null: a class alone)."""
    rows = docs.select(row_hash(doc_id, text).alias("own_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = written(signed(rows), "signatures")
    reps = base.where("content IS NOT NULL").groupBy("content").agg(F.min("own_row").alias("own_row"), F.first("bands").alias("bands"))
    member = written(reps.select("content", "own_row", F.explode("bands").alias("band")), "bands")
    lead = member.groupBy("band").agg(F.min("content").alias("lead"), F.max("content").alias("last")).where("lead < last").select("band", "lead")
    shared = written(member.join(lead, "band"), "buckets")
    pairs = shared.where("content <> lead").select("lead", "content").distinct()
    need = shared.groupBy("own_row").agg(F.first("content").alias("content")).select("own_row")
    wanted = rows.join(need, "own_row").select("text")
    items = written(expanded(wanted).dropDuplicates(["content"]), "items")
    left = items.select(F.col("content").alias("lead"), F.struct("weight", "items").alias("x"))
    right = items.select("content", F.struct("weight", "items").alias("y"))
    light = items.select("content", "weight")
    near = pairs.join(light, "content").join(light.select(F.col("content").alias("lead"), F.col("weight").alias("lead_weight")), "lead")
    near = near.where(F.least("weight", "lead_weight") >= F.lit(similar) * F.greatest("weight", "lead_weight") - 1e-9).select("lead", "content")
    links = near.join(right, "content").join(left, "lead").where(_similar("x", "y", similar))
    label = components(links.select(F.col("lead").alias("a"), F.col("content").alias("b")))
    # buckets whose members, the leader apart, are in several components
    named = shared.where("content <> lead").join(label.withColumnRenamed("node", "content"), "content", "left")
    named = written(named.select("band", "content", F.coalesce("root", "content").alias("comp")), "members")
    open_ = named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = named.join(open_, "band").withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "content", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = dealt.join(items, "content").groupBy("band", "i", "j").applyInPandas(lambda pdf: _forest(pdf[["content", "comp", "items"]], similar), "a binary, b binary")
    found = written(found.distinct(), "late_links")
    if not found.isEmpty():
        own = label.select(F.col("node").alias("a"), F.col("root").alias("b"))
        label = components(own.unionByName(found))
    return base.select("own_row", "doc_id", "content").join(label.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))


def row_hash(doc_id: str, text: str):
    """Identity of a row by its id and text, 128 bits."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """doc_id and class_id (the least id of its class) of every row."""
    own = written(classes(docs, doc_id, text, similar), "classes")
    # the least id of each content first, so that a class of many copies is small when it is joined
    least = own.where("content IS NOT NULL").groupBy("content", "root").agg(F.min("doc_id").alias("id"))
    by_root = least.groupBy("root").agg(F.min("id").alias("class_id"))
    table = written(least.select("content", "root").join(by_root, "root").select("content", "class_id"), "class_ids")
    return own.select("doc_id", "content").join(table, "content", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of `docs`, one of each class: that of the least id (nulls last). Rows without characters all stay."""
    own = written(classes(docs, doc_id, text, similar), "classes")
    first = own.where("content IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own_row")).alias("k"))
    kept = first.select(F.col("k.own_row").alias("own_row")).unionByName(own.where("content IS NULL").select("own_row").distinct())
    kept = written(kept.distinct(), "kept")
    # the document travels as one column, so that its own columns may have any name
    rows = docs.select(F.struct(*docs.columns).alias("doc"), row_hash(doc_id, text).alias("own_row")).join(kept, "own_row", "left_semi")
    twice = own.groupBy("own_row", (F.col("content").isNull()).alias("bare")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND NOT bare")
    if not twice.isEmpty():
        again = rows.join(twice.select("own_row"), "own_row", "left_semi").dropDuplicates(["own_row"])
        rows = rows.join(twice.select("own_row"), "own_row", "left_anti").unionByName(again)
    return rows.select("doc.*")
