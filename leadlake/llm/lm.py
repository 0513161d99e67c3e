"""Cross-entropy difference of two matched bigram models.

Both models share one vocabulary (every word of all documents), one order and
one smoothing; the background model counts every document, the target model
those of the target.  A document is scored by what all *other* documents say:
its own counts are taken out first.  With the counts c that are left, a token w
after v (each document begins after a start mark) has the probability

    (c(v w) + M u(w)) / (c(v) + M),   u(w) = (c(w) + 1) / (n + V)

with M the mean count of the model's contexts, which matches models of different
size.  A document's score is the mean over its tokens of the target's loss less
the background's: the lower, the more like the target.

All counts are exact and stay on the cluster (bigrams and words are told apart
by 62-bit hashes); what is gathered grows with the corpus:

1. each task reads its documents once and writes them as word numbers, in shares
   of about `SHARE_TOKENS` tokens;
2. each share sends its distinct bigrams and words with their counts, dealt by
   range of the hash; each range adds up its keys and answers every share with
   the sums, in the share's own order;
3. each share meets its answers and works out its documents' losses.

A share sends a key once however often it holds it, so a range's size follows
the distinct keys, and a frequent key costs one entry a share.  A word's count
as a context is its count less that of the documents it ends.

Null, empty and wordless documents have no tokens: losses and score are null.
Repeated rows count and score each time (each is another document to its copy).
Documents that `counted` leaves out are scored and not counted.  Without target
rows the target model is uniform.  An empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .text import mix, parts, words

#: Tokens of one share, and keys that one range adds up at once (expected).
SHARE_TOKENS, RANGE_KEYS = 1_000_000, 400_000
#: Shares or ranges of one task.
TASK_GROUPS = 8
START = np.uint64(1)
#: Kinds of keys, in their lowest two bits.
PAIR, WORD = 0, 1
SIDES = ("background", "target")
#: Counts of a key; the last two are of documents that end with a word.
COUNTS = (*SIDES, "background_last", "target_last")


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, which compress where numbers are small; the first byte tells how many planes."""
    x = np.asarray(x, np.uint64)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :width].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Rising keys by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


class Share:
    """The distinct keys of some documents, in rising order, and where each token's are."""

    def __init__(self, vocabulary: np.ndarray, at: np.ndarray, docs: list[dict]):
        self.docs, self.at = docs, at
        self.n = np.array([d["n_tokens"] for d in docs], np.int64)
        self.target, self.counted = (np.array([bool(d[c]) for d in docs], bool) for c in ("target", "counted"))
        self.doc = np.repeat(np.arange(len(docs)), self.n)
        some = self.n > 0
        self.end = np.cumsum(self.n)[some] - 1  # last token of each document that has one
        self.head = self.end - self.n[some] + 1
        word = vocabulary[at]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[self.head] = START
        kind = lambda h, k: (mix(h) & ~np.uint64(3)) | np.uint64(k)
        pair, place = np.unique(kind(mix(context) + word, PAIR), return_inverse=True)
        keys = np.concatenate([pair, kind(vocabulary, WORD)])
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        self.keys, self.pair_at, self.word_rank = keys[order], rank[: len(pair)][place], rank[len(pair) :]

    @classmethod
    def of(cls, row) -> Share:
        return cls(unpacked_keys(row["words"]), unpacked(row["tokens"]).astype(np.int64), list(row["docs"]))

    def counts(self) -> list[np.ndarray]:
        """COUNTS of each key in these documents."""
        out = []
        for marks in (self.counted, self.counted & self.target):
            own = marks[self.doc]
            out.append(np.bincount(self.pair_at[own], minlength=len(self.keys)) + np.bincount(self.word_rank[self.at[own]], minlength=len(self.keys)))
        for marks in (self.counted, self.counted & self.target):
            out.append(np.bincount(self.word_rank[self.at[self.end[marks[self.doc[self.end]]]]], minlength=len(self.keys)))
        return out

    def own(self, at: np.ndarray) -> np.ndarray:
        """How often each token's `at` occurs in the token's own document."""
        _, inverse, count = np.unique(self.doc * (int(at.max(initial=0)) + 1) + at, return_inverse=True, return_counts=True)
        return count[inverse]

    def losses(self, sums: dict[str, np.ndarray], model: Model) -> dict[str, np.ndarray]:
        """Mean loss by side of each document, by the counts of all others (nan without tokens)."""
        own_pair, own_word = self.own(self.pair_at), self.own(self.at)
        final = np.full(len(self.docs), -1)
        final[self.doc[self.end]] = self.at[self.end]
        own_context = own_word - (self.at == final[self.doc])
        out = {}
        for side in SIDES:
            mine = (self.counted & self.target if side == "target" else self.counted)[self.doc]
            word = sums[side][self.word_rank]
            context = (word - sums[f"{side}_last"][self.word_rank])[self.at] - np.where(mine, own_context, 0)
            before = np.empty_like(context)
            before[1:] = context[:-1]
            before[self.head] = model.starts[side] - mine[self.head]
            total = model.total[side] - np.where(mine, self.n[self.doc], 0)
            prior = (word[self.at] - np.where(mine, own_word, 0) + 1) / (total + model.ids)
            loss = -np.log((sums[side][self.pair_at] - np.where(mine, own_pair, 0) + model.mass[side] * prior) / (before + model.mass[side]))
            out[side] = np.bincount(self.doc, loss, len(self.docs)) / np.where(self.n > 0, self.n, np.nan)
        return out


@dataclass
class Model:
    """What all losses share: tokens, documents with tokens and mean count of a context by side, and V."""

    total: dict[str, float]
    starts: dict[str, int]
    mass: dict[str, float]
    ids: int


def shares(rows: DataFrame) -> DataFrame:
    """Shares of (doc_id, text, target, counted, task) rows: word hashes, the number of each token's, documents; share numbers are unique over tasks."""
    kind = dict(rows.dtypes)["doc_id"]

    def share(held: list[tuple], place: int) -> pa.RecordBatch:
        word, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        vocabulary, at = np.unique(word, return_inverse=True)
        docs = pa.StructArray.from_arrays([pa.concat_arrays([h[2] for h in held]), pa.array(n, pa.int64()), *(pa.concat_arrays([h[i] for h in held]) for i in (3, 4))], ["doc_id", "n_tokens", "target", "counted"])
        lists = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), docs)
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([packed_keys(vocabulary)], pa.binary()), pa.array([packed(at)], pa.binary()), pa.array([len(at)], pa.int64()), lists], ["share", "words", "tokens", "n_tokens", "docs"])

    def run(batches):
        held, tokens, size, place = [], 0, 0, None
        for b in batches:
            for part, texts in parts(b, 1):
                if place is None:
                    place = part.column(4)[0].as_py() << 32
                word, doc, *_ = words(texts)
                held.append((word, np.bincount(doc, minlength=len(texts)), *(part.column(i) for i in (0, 2, 3))))
                tokens, size = tokens + len(word), size + len(texts)
                if tokens >= SHARE_TOKENS or size >= SHARE_TOKENS:
                    yield share(held, place)
                    held, tokens, size, place = [], 0, 0, place + 1
        if held:
            yield share(held, place)

    return rows.mapInArrow(run, f"share long, words binary, tokens binary, n_tokens long, docs array<struct<doc_id: {kind}, n_tokens: bigint, target: boolean, counted: boolean>>")


def dealt(base: DataFrame, ranges: int) -> DataFrame:
    """(range, share, keys, counts) of every range that a share has keys of."""

    def run(batches):
        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                share = Share.of(row)
                own = ((share.keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cut = np.append(np.flatnonzero(np.diff(own, prepend=np.uint64(ranges))), len(own)).tolist()
                runs = list(zip(cut[:-1], cut[1:], strict=True))
                blob = lambda f, x: pa.array([f(x[s:e]) for s, e in runs], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([int(own[s]) for s, _ in runs], pa.int64()), pa.array([row["share"]] * len(runs), pa.int64()), blob(packed_keys, share.keys), *(blob(packed, c) for c in share.counts())], ["range", "share", "keys", *COUNTS])

    return base.select("share", "words", "tokens", "docs").mapInArrow(run, f"range long, share long, keys binary, {', '.join(f'{c} binary' for c in COUNTS)}")


def spread(rows: DataFrame, key: str, groups: int) -> DataFrame:
    """Dealt by key over more partitions than the session's number where there are many groups, so that a task's share stays bounded at any size."""
    wanted = -(-groups // TASK_GROUPS)
    return rows.repartition(wanted, key) if wanted > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


TOTALS = ("words", "background_words", "target_words", "background_contexts", "target_contexts")
ANSWER = ", ".join(["range long", "share long", *(f"{c} binary" for c in COUNTS), *(f"{c} long" for c in TOTALS)])


def _add(own: pd.DataFrame) -> pd.DataFrame:
    """A range's sums, answered share by share; the first answer carries the range's totals."""
    keys = [unpacked_keys(x) for x in own["keys"]]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = {c: np.bincount(at, np.concatenate([unpacked(x) for x in own[c]]), len(distinct)).astype(np.int64) for c in COUNTS}
    size = np.array([len(k) for k in keys])
    stop = np.cumsum(size)
    out = own[["range", "share"]].copy()
    for c in COUNTS:
        out[c] = [packed(sums[c][at[e - n : e]]) for n, e in zip(size.tolist(), stop.tolist(), strict=True)]
    word = (distinct & np.uint64(3)) == WORD
    found = [(word & (sums["background"] > 0)).sum(), *(sums[s][word].sum() for s in SIDES), *((word & (sums[s] > sums[f"{s}_last"])).sum() for s in SIDES)]
    for c, n in zip(TOTALS, found, strict=True):
        out[c] = (np.arange(len(own)) == 0) * int(n)
    return out


def score(docs: DataFrame, target, counted=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference, per token) of every row.

    `target` is a boolean column that tells the target's documents, `counted` one
    that tells those whose counts make the models (none: all); null is false.
    """
    true = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(target, F.lit(False)).alias("target"), true.alias("counted"), F.spark_partition_id().alias("task"))
    base = written(shares(rows), "lm-shares")
    size = base.agg(F.sum("n_tokens")).first()[0] or 0
    each = base.select(F.inline("docs")).where("counted AND n_tokens > 0")
    starts = each.agg(F.count(F.lit(1)).alias("background"), F.count_if("target").alias("target")).first().asDict()
    ranges = min(1 << 31, max(1, -(-size // RANGE_KEYS)))
    answers = written(spread(dealt(base, ranges), "range", ranges).groupBy("range").applyInPandas(_add, ANSWER), "lm-answers")
    sums = {c: n or 0 for c, n in answers.agg(*(F.sum(c).alias(c) for c in TOTALS)).first().asDict().items()}
    total = {s: float(sums[f"{s}_words"]) for s in SIDES}
    contexts = {s: sums[f"{s}_contexts"] + (starts[s] > 0) for s in SIDES}
    model = Model(total, starts, {s: max(1.0, total[s] / max(1, contexts[s])) for s in SIDES}, sums["words"] + 2)
    kind = dict(rows.dtypes)["doc_id"]

    def finish(own: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        share = Share.of(own.iloc[0])
        answer = answer.sort_values("range")
        loss = share.losses({c: np.concatenate([unpacked(x) for x in answer[c]] or [np.zeros(0, np.uint64)]).astype(np.int64) for c in COUNTS}, model)
        out = pd.DataFrame({"doc_id": pd.Series([d["doc_id"] for d in share.docs], dtype=object), "n_tokens": share.n, "target_loss": loss["target"], "background_loss": loss["background"]})
        out["score"] = out["target_loss"] - out["background_loss"]
        return out

    groups = base.count()
    own = spread(base.select("share", "words", "tokens", "docs"), "share", groups).groupBy("share")
    found = own.cogroup(spread(answers.select("share", "range", *COUNTS), "share", groups).groupBy("share")).applyInPandas(finish, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return found.select("doc_id", "n_tokens", *(F.nanvl(F.col(c), F.lit(None)).alias(c) for c in ("target_loss", "background_loss", "score")))
