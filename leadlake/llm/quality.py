"""Document quality by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Each byte is embedded; learned filters slide over a chunk, and the largest
answer of every filter in the chunk is kept.  A small dense layer turns a
chunk's answers into one logit; the least, mean and largest logits of all
chunks, with the log of their number, are combined into one probability.

Filters, embedding and layers are trained together with Adam on chunks of a
bounded sample of labelled documents, the combination on whole documents that
the first step did not see.  Null and empty texts are one blank chunk and get
its probability.  Repeated rows are scored alike.  Without rows of both labels
every score is the share of good rows (1 without any row).  An empty table gives
no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .text import parts

CHUNK, STEP, WIDTH, STRIDE = 512, 448, 10, 2
EMBED, FILTERS, HIDDEN = 8, 48, 24
#: Bounds of the training sample, of each label; chunks of one document in training.
LABEL_DOCS, TRAIN_CHUNKS, SAMPLE_CHARS = 1500, 6, 20_000
EPOCHS, BATCH, RATE = 10, 64, 3e-3
#: Chunks that are convolved at once.
BLOCK = 256


@dataclass
class Model:
    parts: dict[str, np.ndarray] = field(default_factory=dict)
    combine: np.ndarray = field(default_factory=lambda: np.zeros(5))
    constant: float | None = None


def chunks(raw: bytes) -> np.ndarray:
    """Overlapping chunks that cover all bytes, the last one filled with byte 0."""
    n = max(1, -(-(len(raw) - (CHUNK - STEP)) // STEP))
    data = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(data, (n, CHUNK), (STEP, 1))


def _patches(x: np.ndarray, embed: np.ndarray) -> np.ndarray:
    e = embed[x]
    n = (CHUNK - WIDTH) // STRIDE + 1
    view = np.lib.stride_tricks.as_strided(e, (len(x), n, WIDTH * EMBED), (e.strides[0], STRIDE * e.strides[1], e.strides[2]))
    return np.ascontiguousarray(view)


def _logits(pooled: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    active = np.maximum(pooled + p["filter_bias"], 0)
    hidden = np.tanh(active @ p["dense"] + p["dense_bias"])
    return hidden @ p["out"] + p["out_bias"], hidden, active


def chunk_logits(x: np.ndarray, p: dict) -> np.ndarray:
    out = []
    for i in range(0, len(x), BLOCK):
        patch = _patches(x[i : i + BLOCK], p["embed"])
        out.append(_logits((patch.reshape(-1, patch.shape[2]) @ p["filter"]).reshape(*patch.shape[:2], -1).max(axis=1), p)[0])
    return np.concatenate(out)


def features(texts: list[str | None], p: dict) -> np.ndarray:
    """Least, mean and largest chunk logit and log of the number of chunks, of each whole text."""
    rows = np.zeros((len(texts), 4))
    held, size, first = [], 0, 0

    def flush(stop):
        if held:
            logit = chunk_logits(np.concatenate(held), p)
            at = np.cumsum([0, *map(len, held)])
            rows[first:stop, 0] = np.minimum.reduceat(logit, at[:-1])
            rows[first:stop, 1] = np.add.reduceat(logit, at[:-1]) / np.diff(at)
            rows[first:stop, 2] = np.maximum.reduceat(logit, at[:-1])
            rows[first:stop, 3] = np.log(np.diff(at))

    for i, t in enumerate(texts):
        own = chunks((t or "").encode("utf-8", "surrogatepass"))
        if held and size + len(own) > 4096:
            flush(i)
            held, size, first = [], 0, i
        held.append(own)
        size += len(own)
    flush(len(texts))
    return rows


def predict(texts: list[str | None], model: Model) -> np.ndarray:
    """Probability that each whole text is of good quality."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = features(texts, model.parts)
    z = np.column_stack([x, np.ones(len(x))]) @ model.combine
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_filters(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> dict:
    """Embedding, filters and dense layers from chunks, their labels and weights."""
    rng = np.random.default_rng(seed)
    init = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"embed": rng.normal(size=(256, EMBED)).astype(np.float32), "filter": init(WIDTH * EMBED, FILTERS), "filter_bias": np.zeros(FILTERS, np.float32), "dense": init(FILTERS, HIDDEN), "dense_bias": np.zeros(HIDDEN, np.float32), "out": init(HIDDEN), "out_bias": np.zeros((), np.float32)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    turn = 0
    for epoch in range(EPOCHS):
        for b in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            turn += 1
            patch = _patches(x[b], p["embed"])
            flat = patch.reshape(-1, patch.shape[2])
            answer = (flat @ p["filter"]).reshape(*patch.shape[:2], -1)
            best = answer.argmax(axis=1)
            logit, hidden, active = _logits(np.take_along_axis(answer, best[:, None], 1)[:, 0], p)
            d = ((1 / (1 + np.exp(-logit)) - y[b]) * weight[b] / len(b)).astype(np.float32)
            grad = {"out": hidden.T @ d, "out_bias": d.sum()}
            back = np.outer(d, p["out"]) * (1 - hidden**2)
            grad["dense"], grad["dense_bias"] = active.T @ back, back.sum(axis=0)
            pool = (back @ p["dense"].T) * (active > 0)
            grad["filter_bias"] = pool.sum(axis=0)
            row = best + np.arange(len(b))[:, None] * patch.shape[1]
            won = flat[row]  # chunks, filters, patch
            grad["filter"] = np.einsum("cf,cfp->pf", pool, won)
            into = (pool[:, :, None] * p["filter"].T).reshape(len(b), FILTERS, WIDTH, EMBED)
            place = best[:, :, None] * STRIDE + np.arange(WIDTH)
            byte = x[b][np.arange(len(b))[:, None, None], place]
            grad["embed"] = np.stack([np.bincount(byte.ravel(), into[..., j].ravel(), 256) for j in range(EMBED)], axis=1)
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p[k] -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return p


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (weight * (q - y)) + 1e-2 * w)
    return w


def fit(texts: list[str], good: np.ndarray, share: float, seed: int = 3) -> Model:
    """The model from labelled texts; `share` is the part of good rows where they come from."""
    good = np.asarray(good, bool)
    if good.all() or not good.any():
        return Model(constant=float(share))
    weight = np.where(good, share / good.mean(), (1 - share) / (1 - good.mean()))
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(texts)) % 3 == 0
    x, y, w = [], [], []
    for t, g, f in zip(texts, good, fold, strict=True):
        if not f:
            own = chunks(t.encode("utf-8", "surrogatepass"))
            own = own[np.sort(rng.permutation(len(own))[:TRAIN_CHUNKS])]
            x.append(own)
            y += [float(g)] * len(own)
            w += [1.0] * len(own)
    parts = fit_filters(np.concatenate(x), np.array(y), np.array(w), seed)
    rest = np.flatnonzero(fold)
    combine = _logistic(features([texts[i] for i in rest], parts), good[rest].astype(float), weight[rest])
    return Model(parts, combine)


def train(docs: DataFrame, labels: DataFrame, held_out=None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", label_docs: int = LABEL_DOCS) -> Model:
    """fit() over at most `label_docs` rows of each label that are not held out."""
    own = labels.select(doc_id, label).where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if held_out is not None:
        own = own.where(~held_out)
    share = own.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    sides = [sampling.by_hash(own.where(F.col(label) == v), doc_id, label_docs).withColumn("own_label", F.lit(v)) for v in (0, 1)]
    known = sides[0].unionByName(sides[1]).groupBy(doc_id).agg(F.max("own_label").alias("own_label"))
    some = sampling.fetch(docs, known, doc_id, [text], SAMPLE_CHARS)
    marks = dict(known.toPandas().itertuples(index=False))
    return fit(some[text].tolist(), np.array([marks[i] == 1 for i in some[doc_id]], bool), 1.0 if share is None else share)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            for part, texts in parts(b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(predict(texts, shared.value), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")
