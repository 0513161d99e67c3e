"""Toxic passages as maximum-scoring segments of token log-odds.

Training (a bounded sample of labelled rows): every word, and every prefix of
`PREFIXES` letters of it, is a token; a token counts once in each distinct
document.  Its score is the log-odds ratio of the toxic against the other
documents under a Dirichlet prior of `PRIOR` times the token's count in both,
kept if it differs from 0 by `Z` standard deviations or gains `GAIN` nats of
likelihood, and lowered to a sure bound.  All other words cost `DRIFT`, so scores fall outside toxic passages.

Scoring: one linear scan finds all maximal segments of a document's words.  By
extreme-value theory a segment of score S in n words has expectation
K n exp(-l S) in clean text; l and K come from the clean sample.  The sums of the r
best segments give a p-value for each r (Poisson sum statistic); the least one,
p, makes the score a / (a + p), with a the rate of false alarms aimed at.

Null, empty and wordless texts have no segment and the least score.  Repeated
rows are scored alike; in training, rows of one id count once.  Without toxic
or without clean training rows no token is kept.  An empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .text import RunHasher, mix, parts, shingles, slices, spans, words

PREFIXES = (4, 5, 6)
Z, DRIFT, TOP, PRIOR = 3.3, -0.6, 8.0, 0.05
#: Nats by which a token's likelihood gains if it is kept whatever its deviation, and of the bound of its score.
GAIN, BOUND = 10.0, 3.0
#: A prefix is kept if it begins so many different words and is so many times likelier in toxic documents.
#: No word may make up more than this share of a prefix's toxic documents.
TYPES, PURE, SHARE = 3, 30, 0.7
#: Bounds of the training sample and of the model.
TOXIC_DOCS, CLEAN_DOCS, TOKENS, SAMPLE_CHARS = 3000, 5000, 50_000, 20_000
#: Documents that a token needs, and buckets by which rarer tokens are left out before rows are held.
LEAST, _BUCKETS = 4, 1 << 22
#: Parts, by token, in which rows are held and counted.
_SHARDS = 16
_BITS = 1 << 18


@dataclass
class Model:
    keys: np.ndarray  # sorted token hashes
    scores: np.ndarray
    lam: float
    k: float
    alarm: float

    def __post_init__(self):
        self.seen = np.zeros(_BITS, bool)
        self.seen[(self.keys & np.uint64(_BITS - 1)).astype(np.int64)] = True


def token_hashes(texts: list[str]):
    """(hashes by kind: word, then each prefix; text index, start, end)."""
    h, doc, start, end, cp = words(texts)
    hasher = RunHasher(cp)
    kinds = [h]
    for n in PREFIXES:
        stop = np.minimum(start + n, end)
        kinds.append(np.where(end - start >= n, mix(hasher(start, stop) + np.uint64(n)), np.uint64(0)))
    return kinds, doc, start, end


def word_scores(kinds: list[np.ndarray], model: Model) -> np.ndarray:
    """The best positive score of a word's tokens, else the score of the word, else the drift."""
    best = np.full(len(kinds[0]), DRIFT)
    for i, h in enumerate(kinds):
        near = np.flatnonzero(model.seen[(h & np.uint64(_BITS - 1)).astype(np.int64)])
        if not len(near) or not len(model.keys):
            continue
        at = np.minimum(np.searchsorted(model.keys, h[near]), len(model.keys) - 1)
        hit = model.keys[at] == h[near]
        near, value = near[hit], model.scores[at[hit]]
        if i == 0:
            best[near] = value
        else:
            up = value > np.maximum(best[near], 0)
            best[near[up]] = value[up]
    return best


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score), by one scan over the runs of positive scores."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, the last one before it of a smaller sum before
    for i in up.tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((start, end, left, right, j))
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
    return [(s, e, r - lf) for s, e, lf, r, _ in held]


def p_value(scores: list[float], n: int, model: Model) -> float:
    """Least p-value of the r best segments' sum, over r."""
    least, total = 1.0, 0.0
    base = math.log(max(model.k * n, 1e-300))
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += model.lam * s - base
        if total <= 0:
            break
        if r == 1:
            p = -math.expm1(-math.exp(-total))
        else:
            p = math.exp(min(0.0, -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)))
        least = min(least, p)
        if r >= 50:
            break
    return max(least, 1e-300)


def document_scores(texts: list[str | None], model: Model) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
    """Score of each text, and its significant passages (first and last code point of the lower-cased text, score)."""
    out, found = [], []
    for _, part in slices(texts):
        kinds, doc, start, end = token_hashes(part)
        score = word_scores(kinds, model)
        at = spans(doc, len(part))
        offset = np.concatenate([[0], np.cumsum([len(t.lower()) for t in part])])
        toxic = np.bincount(doc[score > 0], minlength=len(part)) > 0
        for i in range(len(part)):
            if not toxic[i]:
                out.append(model.alarm / (1 + model.alarm))
                found.append([])
                continue
            a, b = int(at[i]), int(at[i + 1])
            segments = maximal_segments(score[a:b])
            p = p_value([s for _, _, s in segments], b - a, model)
            out.append(model.alarm / (model.alarm + p))
            sure = [(int(start[a + s] - offset[i]), int(end[a + e - 1] - offset[i]), v) for s, e, v in segments if model.k * (b - a) * math.exp(-model.lam * v) < 10 * model.alarm]
            found.append(sure)
    return out, found


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """First row of each distinct combination."""
    total = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        total = mix(total + c.astype(np.uint64) + np.uint64(1))
    return np.unique(total, return_index=True)[1]


def _tokens(h: np.ndarray, d: np.ndarray, kind: np.ndarray, word: np.ndarray, toxic: np.ndarray, held: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept tokens, their scores and deviations from (token, document, kind, word) rows of the documents in use, which have `held` tokens each."""
    n1, n0 = held[use & toxic].sum(), held[use & ~toxic].sum()
    if not use.all():
        own = use[d]
        h, d, kind, word = h[own], d[own], kind[own], word[own]
    token, first, at = np.unique(h, return_index=True, return_inverse=True)
    kind = kind[first]
    types = np.bincount(at[_distinct(at, word)], minlength=len(token))
    rows = np.flatnonzero(toxic[d])
    _, some, count = np.unique(mix(at[rows].astype(np.uint64)) + word[rows], return_index=True, return_counts=True)
    most = np.zeros(len(token))
    np.maximum.at(most, at[rows[some]], count)
    once = _distinct(at, d)
    y1 = np.bincount(at[once], toxic[d[once]], len(token))
    y0 = np.bincount(at[once], ~toxic[d[once]], len(token))
    prior, mass = PRIOR * (y1 + y0), PRIOR * (n1 + n0)
    odds = lambda y, n: np.log(y + prior) - np.log(n + mass - y - prior)
    delta = odds(y1, n1) - odds(y0, n0)
    deviation = np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
    z = delta / deviation
    # counts too small for a normal deviation: the gain of likelihood over the share that all tokens have
    share, base = y1 / np.maximum(y1 + y0, 1), n1 / (n1 + n0)
    gain = np.where(share > base, (y1 + y0) * _divergence(share, base), 0.0)
    keep = ((np.abs(z) >= Z) | (gain >= GAIN)) & (y1 + y0 >= LEAST)
    keep &= (kind == 0) | ((delta > 0) & (types >= TYPES) & (most <= SHARE * y1) & (y1 * n0 >= PURE * y0 * n1))
    score = np.where(delta > 0, np.clip(np.maximum(delta - 2 * deviation, _least_odds(share, y1 + y0, base)), 0.1, TOP), np.maximum(np.minimum(delta, DRIFT), -TOP))
    return token[keep], score[keep], np.maximum(np.abs(z), np.sqrt(2 * gain))[keep]


def _divergence(p: np.ndarray, q) -> np.ndarray:
    """Kullback-Leibler divergence of two-valued distributions."""
    part = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-300) / np.maximum(b, 1e-300)), 0.0)
    return part(p, q) + part(1 - p, 1 - q)


def _least_odds(share: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """The least log-odds ratio (0 to `TOP`) whose likelihood is within `BOUND` nats of the best."""
    low, high = np.zeros(len(share)), np.full(len(share), TOP)
    for _ in range(30):
        mid = (low + high) / 2
        q = 1 / (1 + (1 - base) / base * np.exp(-mid))
        far = (q < share) & (n * _divergence(share, q) > BOUND)
        low, high = np.where(far, mid, low), np.where(far, high, mid)
    return low


def _kept(shards: list[list[tuple]], *masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens, the surest `TOKENS` of all shards, and their scores."""
    found = [_tokens(*map(np.concatenate, zip(*rows, strict=True)), *masks) for rows in shards if rows]
    token, score, z = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(-z, kind="stable")[:TOKENS]
    order = order[np.argsort(token[order])]
    return token[order], score[order]


def fit(texts: list[str], toxic: np.ndarray, alarm: float = 0.004) -> Model:
    """The model from labelled texts; those that share their least shingle hash count as one.

    l and K are found on every second clean document with tokens of the others,
    so that they hold for documents that the tokens have not seen.
    """
    sketch, held = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
    met = np.zeros(_BUCKETS, np.int32)
    bucket = lambda h: (h & np.uint64(_BUCKETS - 1)).astype(np.int64)
    for first, part in slices(texts):
        kinds, doc, _, _ = token_hashes(part)
        s, d = shingles(kinds[0], doc, len(part), 5)
        at = spans(d, len(part))
        for i in range(len(part)):
            if at[i + 1] > at[i]:
                sketch[first + i] = s[at[i] : at[i + 1]].min()
        for h in kinds:
            rows = np.flatnonzero(h > 0)
            rows = rows[_distinct(h[rows], doc[rows])]
            held[first : first + len(part)] += np.bincount(doc[rows], minlength=len(part))
            np.add.at(met, bucket(h[rows]), 1)
    shards: list[list[tuple]] = [[] for _ in range(_SHARDS)]
    for first, part in slices(texts):
        kinds, doc, _, _ = token_hashes(part)
        for i, h in enumerate(kinds):
            rows = np.flatnonzero((h > 0) & (met[bucket(h)] >= LEAST))
            rows = rows[_distinct(h[rows], doc[rows], kinds[0][rows])]
            place = (h[rows] >> np.uint64(32)) % np.uint64(_SHARDS)
            for j in range(_SHARDS):
                own = rows[place == j]
                if len(own):
                    shards[j].append((h[own], (doc[own] + first).astype(np.int32), np.full(len(own), i, np.int8), kinds[0][own]))
    use = np.zeros(len(texts), bool)
    use[_distinct(sketch, toxic)] = True
    if not any(shards) or not (use & toxic).any() or not (use & ~toxic).any():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, alarm)
    even = np.arange(len(texts)) % 2 == 0
    half = Model(*_kept(shards, toxic, held, use & even), 1.0, 1.0, alarm)
    half = _calibrate(half, [texts[i] for i in np.flatnonzero(use & ~even & ~toxic)])
    return Model(*_kept(shards, toxic, held, use), half.lam, half.k, alarm)


def _calibrate(model: Model, clean: list[str]) -> Model:
    """l solves E[exp(l s)] = 1 over the words of clean texts; K gives clean texts the rate of false alarms aimed at."""
    levels, best, length = [], [], []
    for _, part in slices(clean):
        kinds, doc, _, _ = token_hashes(part)
        score = word_scores(kinds, model)
        levels.append(score)
        at = spans(doc, len(part))
        for i in range(len(part)):
            own = score[at[i] : at[i + 1]]
            length.append(len(own))
            best.append(max((s for _, _, s in maximal_segments(own)), default=0.0))
    s = np.concatenate(levels) if levels else np.zeros(0)
    value, count = np.unique(np.round(np.append(s, TOP), 3), return_counts=True)  # one pseudo count at the top
    share = count / count.sum()
    low, high = 1e-6, 1.0
    moment = lambda x: float((share * np.exp(x * value)).sum())
    while moment(high) < 1 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 1 else (low, mid)
    lam = low if low > 1e-3 else 1e-3
    tail = np.sort(np.array(length) * np.exp(-lam * np.array(best))) if best else np.ones(1)
    level = min(1.0, max(model.alarm, 5 / len(tail)))
    k = float(np.clip(level / max(np.quantile(tail, level), 1e-9), 1e-9, 10.0))
    return Model(model.keys, model.scores, lam, k, model.alarm)


def train(docs: DataFrame, labels: DataFrame, held_out=None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", alarm: float = 0.004, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Model:
    """fit() over a sample of at most `toxic_docs` and `clean_docs` labelled rows that are not held out."""
    own = labels.select(doc_id, label).where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if held_out is not None:
        own = own.where(~held_out)
    ids = sampling.by_hash(own.where(F.col(label) == 1), doc_id, toxic_docs).withColumn("own_label", F.lit(1))
    ids = ids.unionByName(sampling.by_hash(own.where(F.col(label) == 0), doc_id, clean_docs).withColumn("own_label", F.lit(0)))
    known = ids.groupBy(doc_id).agg(F.max("own_label").alias("own_label"))
    some = sampling.fetch(docs, known, doc_id, [text], SAMPLE_CHARS)
    marks = dict(known.toPandas().itertuples(index=False))
    return fit(some[text].tolist(), np.array([bool(marks[i]) for i in some[doc_id]], bool), alarm)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and passages (begin, end, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    passage = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            for part, texts in parts(b, 1):
                value, found = document_scores(texts, shared.value)
                nested = [[{"begin": s, "end": e, "score": v} for s, e, v in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value, pa.float64()), pa.array(nested, passage)], ["doc_id", "score", "passages"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<begin: bigint, end: bigint, score: double>>")
