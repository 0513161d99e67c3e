"""Language of documents by a linear-chain conditional random field over words.

Each word emits the sum of learned weights of its prefixes and suffixes (one to
three characters), its character bigrams and trigrams, and of the lexicons that
hold it (the commonest words of each language in the training sample);
transitions between the languages of neighbouring words are learned too.
Forward-backward over each sentence (at most `SENTENCE` words) gives every word
its language probabilities, so passages in another language are seen as such;
a document's language has the largest sum over all its words, and its score is
that sum's share.

Trained on a bounded sample of documents of each language by stochastic
gradient; part of the training sequences join sentences of two documents, which
teaches switches.  Null texts, and texts without a letter, are `und` with score
0, as is everything without training rows.  Equal sums take the first language
in alphabetical order.  Repeated rows are labelled alike.  An empty table gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sampling
from .text import LETTER, RunHasher, kinds_of, mix, parts, slices, words

SENTENCE, ROWS = 40, 1 << 16
#: Bounds of the training sample: documents, lexicon words and sequences of a language.
LANGUAGE_DOCS, LEXICON, SEQUENCES = 250, 300, 3000
EPOCHS, BATCH, RATE, SHRINK = 4, 128, 0.15, 1e-5


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # ROWS hashed features, then one row for each lexicon
    moves: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    member: np.ndarray  # lexicon words by languages


@dataclass
class Words:
    """Words with a letter of some texts; features of each distinct one as (row, owner) pairs."""

    doc: np.ndarray
    sentence: np.ndarray
    place: np.ndarray  # in the sentence
    distinct: np.ndarray  # index of each word's distinct form
    keys: np.ndarray
    rows: np.ndarray
    owner: np.ndarray


def analyse(texts: list[str]) -> Words:
    h, doc, start, end, cp = words(texts)
    letters = np.concatenate([[0], np.cumsum(kinds_of(cp) == LETTER)])
    use = letters[end] > letters[start]
    h, doc, start, end = h[use], doc[use], start[use], end[use]
    stops = np.concatenate([[0], np.cumsum(np.isin(cp, np.frombuffer(".!?\n".encode("utf-32-le"), np.uint32)))])
    n = len(h)
    fresh = np.ones(n, bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (stops[start[1:]] > stops[end[:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    fresh |= (np.arange(n) - head) % SENTENCE == 0
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else head
    keys, some, distinct = np.unique(h, return_index=True, return_inverse=True)
    s, e = start[some], end[some]
    hasher = RunHasher(cp)
    rows, owner = [], []
    for k in (1, 2, 3):
        for salt, a, b in ((11 * k, s, np.minimum(s + k, e)), (11 * k + 1, np.maximum(e - k, s), e)):
            rows.append(mix(hasher(a, b) + np.uint64(salt)))
            owner.append(np.arange(len(s)))
    for k in (2, 3):
        count = np.maximum(e - s - k + 1, 0)
        own = np.repeat(np.arange(len(s)), count)
        at = np.repeat(s, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rows.append(mix(hasher(at, at + k) + np.uint64(101 * k)))
        owner.append(own)
    return Words(doc, np.cumsum(fresh) - 1, np.arange(n) - head, distinct, keys, (np.concatenate(rows) & np.uint64(ROWS - 1)).astype(np.int64), np.concatenate(owner))


def analyse_all(texts: list[str]) -> Words:
    """analyse() slice by slice, with the distinct words of all texts."""
    found = [analyse(part) for _, part in slices(texts)]
    first = [at for at, _ in slices(texts)]
    keys = np.unique(np.concatenate([w.keys for w in found] or [np.zeros(0, np.uint64)]))
    seen = np.zeros(len(keys), bool)
    doc, sentence, place, distinct, rows, owner, met = [], [], [], [], [], [], 0
    for at, w in zip(first, found, strict=True):
        own = np.searchsorted(keys, w.keys)
        new = ~seen[own][w.owner]
        seen[own] = True
        doc.append(w.doc + at)
        sentence.append(w.sentence + met)
        met += int(w.sentence[-1]) + 1 if len(w.sentence) else 0
        place.append(w.place)
        distinct.append(own[w.distinct])
        rows.append(w.rows[new])
        owner.append(own[w.owner[new]])
    return Words(*(np.concatenate(x or [np.zeros(0, np.int64)]) for x in (doc, sentence, place, distinct)), keys, *(np.concatenate(x or [np.zeros(0, np.int64)]) for x in (rows, owner)))


def emissions(w: Words, model: Model) -> np.ndarray:
    """One row of scores for each distinct word."""
    n, k = len(w.keys), len(model.languages)
    out = np.stack([np.bincount(w.owner, model.weights[:ROWS, j][w.rows], n) for j in range(k)], axis=1) if n else np.zeros((0, k))
    out /= np.sqrt(np.maximum(np.bincount(w.owner, minlength=n), 1))[:, None]
    if n and len(model.lexicon):
        at = np.minimum(np.searchsorted(model.lexicon, w.keys), len(model.lexicon) - 1)
        hit = model.lexicon[at] == w.keys
        out[hit] += model.member[at[hit]] @ model.weights[ROWS:]
    return out


def forward_backward(score: np.ndarray, length: np.ndarray, moves: np.ndarray, transitions: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and, if asked for, summed expected transitions of padded sequences (sequences, words, languages)."""
    b, t, k = score.shape
    e = np.exp(score - score.max(axis=2, keepdims=True))
    a = np.exp(moves).astype(score.dtype)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] = x / x.sum(axis=1, keepdims=True)
    expected = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        ahead = e[:, i + 1] * beta[:, i + 1]
        x = ahead @ a.T
        live = (i + 1 < length)[:, None]
        beta[:, i] = np.where(live, x / x.sum(axis=1, keepdims=True), 1.0)
        if transitions:
            pair = alpha[:, i, :, None] * a * ahead[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            expected += (pair * live[:, :, None]).sum(axis=0)
    both = alpha * beta
    return both / both.sum(axis=2, keepdims=True), expected


def marginals(w: Words, model: Model) -> np.ndarray:
    """Language probabilities of every word."""
    score = emissions(w, model).astype(np.float32)
    out = np.zeros((len(w.doc), len(model.languages)), np.float32)
    length = np.bincount(w.sentence)
    first = np.cumsum(length) - length
    for low, high in ((0, 6), (6, 12), (12, 20), (20, SENTENCE)):
        own = np.flatnonzero((length > low) & (length <= high))
        for part in (own[i : i + 8192] for i in range(0, len(own), 8192)):
            size = int(length[part].max())
            inside = np.arange(size) < length[part][:, None]
            at = np.where(inside, first[part][:, None] + np.arange(size), first[part][:, None])
            found, _ = forward_backward(score[w.distinct[at]], length[part], model.moves, False)
            out[at[inside]] = found[inside]
    return out


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    names, scores = [], []
    for _, part in slices(texts):
        if not model.languages:
            names += ["und"] * len(part)
            scores.append(np.zeros(len(part)))
            continue
        w = analyse(part)
        found = marginals(w, model)
        mass = np.stack([np.bincount(w.doc, found[:, j], len(part)) for j in range(len(model.languages))], axis=1)
        total = mass.sum(axis=1)
        best = np.argmax(mass.round(9), axis=1)
        names += [model.languages[b] if t > 0 else "und" for b, t in zip(best, total, strict=True)]
        scores.append(np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1e-12), 0.0))
    return names, np.clip(np.concatenate(scores), 0, 1) if scores else np.zeros(0)


def fit(texts: list[str], language: list[str], seed: int = 7) -> Model:
    """The model from texts of known language."""
    names = sorted(set(language))
    k = len(names)
    model = Model(names, np.zeros((ROWS + k, k), np.float64), np.zeros((k, k)), np.zeros(0, np.uint64), np.zeros((0, k)))
    w = analyse_all(texts)
    if not k or not len(w.doc):
        return Model([], model.weights, model.moves, model.lexicon, model.member)
    label = np.array([names.index(x) for x in language])[w.doc]
    counts = np.zeros((len(w.keys), k))
    np.add.at(counts, (w.distinct, label), 1)
    member = np.zeros_like(counts)
    for j in range(k):
        top = np.argsort(-counts[:, j], kind="stable")[:LEXICON]
        member[top[counts[top, j] > 1], j] = 1
    held = member.any(axis=1)
    model.lexicon, model.member = w.keys[held], member[held]
    rng = np.random.default_rng(seed)
    length = np.bincount(w.sentence)
    first = np.cumsum(length) - length
    order = rng.permutation(len(length))
    spoken = label[first[order]]
    order = order[np.sort(np.concatenate([np.flatnonzero(spoken == j)[:SEQUENCES] for j in range(k)]))]
    spans = [np.arange(first[i], first[i] + length[i]) for i in order]
    joined = [np.concatenate([spans[i], spans[j]])[:SENTENCE] for i, j in zip(rng.integers(len(spans), size=len(spans) // 2), rng.integers(len(spans), size=len(spans) // 2), strict=True)]
    spans += joined
    by_word = np.argsort(w.owner, kind="stable")
    rows, owner = w.rows[by_word], w.owner[by_word]
    cut = np.searchsorted(owner, np.arange(len(w.keys) + 1))
    scale = 1 / np.sqrt(np.maximum(np.diff(cut), 1))
    speed_w, speed_m = np.full_like(model.weights, 1e-3), np.full((k, k), 1e-3)
    for _ in range(EPOCHS):
        turn = rng.permutation(len(spans))
        turn = turn[np.argsort(np.array([len(spans[i]) for i in turn]) // 8, kind="stable")]
        batches = [turn[i : i + BATCH] for i in range(0, len(turn), BATCH)]
        for b in rng.permutation(len(batches)):
            own = [spans[i] for i in batches[b]]
            n = np.array([len(s) for s in own])
            inside = np.arange(n.max()) < n[:, None]
            at = np.zeros(inside.shape, np.int64)
            at[inside] = np.concatenate(own)
            token = w.distinct[at[inside]]
            some, where = np.unique(token, return_inverse=True)
            count = cut[some + 1] - cut[some]
            hold = np.repeat(np.arange(len(some)), count)
            feats = rows[np.repeat(cut[some], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            score = np.stack([np.bincount(hold, model.weights[feats, j], len(some)) for j in range(k)], axis=1) * scale[some][:, None] + member[some] @ model.weights[ROWS:]
            grid = np.zeros((*inside.shape, k))
            grid[inside] = score[where]
            found, expected = forward_backward(grid, n, model.moves)
            gold = np.zeros((inside.sum(), k))
            gold[np.arange(len(gold)), label[at[inside]]] = 1
            error = np.zeros((len(some), k))
            np.add.at(error, where, found[inside] - gold)
            error /= len(own)
            flow = error[hold] * scale[some][hold][:, None]
            used, back = np.unique(feats, return_inverse=True)
            grad = np.stack([np.bincount(back, flow[:, j], len(used)) for j in range(k)], axis=1) + SHRINK * model.weights[used]
            speed_w[used] += grad**2
            model.weights[used] -= RATE * grad / np.sqrt(speed_w[used])
            lex = member[some].T @ error
            speed_w[ROWS:] += lex**2
            model.weights[ROWS:] -= RATE * lex / np.sqrt(speed_w[ROWS:])
            met = np.zeros((k, k))
            lab = np.where(inside, label[at], -1)
            pair = inside[:, 1:]
            np.add.at(met, (lab[:, :-1][pair], lab[:, 1:][pair]), 1)
            move = (expected - met) / len(own)
            speed_m += move**2
            model.moves -= RATE * move / np.sqrt(speed_m)
    model.weights = model.weights.astype(np.float32)
    return model


def train(docs: DataFrame, held_out=None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", language_docs: int = LANGUAGE_DOCS) -> Model:
    """fit() over at most `language_docs` documents of each language that are not held out, chosen by a hash of the id."""
    own = docs.select(doc_id, lang).where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    if held_out is not None:
        own = own.where(~held_out)
    # by language the least hashes: those that cannot be among them go first, so that no language's ids meet in one task
    own = own.select(F.col(doc_id).alias("own_id"), F.col(lang).alias("own_lang")).distinct().withColumn("own_hash", F.xxhash64("own_id", F.lit(4)))
    share = F.col("own_hash") / F.lit(2.0**64) + 0.5
    near = own.join(F.broadcast(own.groupBy("own_lang").count()), "own_lang").where(share * F.col("count") < 2 * language_docs + 100)
    place = F.row_number().over(Window.partitionBy("own_lang").orderBy("own_hash", "own_id"))
    ids = near.withColumn("own_place", place).where(F.col("own_place") <= language_docs).select(F.col("own_id").alias(doc_id))
    some = sampling.fetch(docs.where(F.col(lang).isNotNull()), ids.distinct(), doc_id, [text, lang], 20_000)
    return fit(some[text].tolist(), some[lang].tolist())


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            for part, texts in parts(b, 1):
                name, score = predict(texts, shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
