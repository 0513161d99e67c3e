"""Runs: maximal periodic stretches of words, by longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period q, at least
`LEAST_TIMES` periods and `LEAST_WORDS` words long, that no neighbouring word
extends with that period.

Harmonic grid.  In a run of period p the places i with word i = word i + p form
a stretch of at least max(LEAST_WORDS, LEAST_TIMES * p) - p places, so one of
its places is a multiple of that width.  For every p only those places are
looked at: n/p of them, n log n in all.  Where the two words agree, the longest
common extension to both sides gives the stretch.  A multiple of a run's
period finds the same stretch, of which the least period stays.

Extensions.  The suffixes that start at places i with i mod T in a difference
cover are sorted, each text's by themselves, by blocks of T words and then by
doubling; the common prefixes of neighbours follow from the ranks of all steps,
and a sparse table gives the least of any range of them.  For any two places
some shift under T brings both into the sample, so a query compares fewer than
T words and looks up one range.  Most pairs part before that: only the texts in
which a pair reaches the sample are sorted.

Words are told apart by their characters.  A null or empty text has no words and
no runs, its collapsed text is empty.  Repeated rows and null ids give one
result row each; further columns are ignored, whatever their names; an empty
table gives no rows.  A text is worked on whole, however long; its grid goes by
in pieces of `GRID` places.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import parts

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Modulus and difference cover: each number below 31 is a difference of two of these six, modulo 31.
T, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Places of the grid looked at together, and bytes of text worked on together.
GRID, SLICE_BYTES = 500_000, 1_000_000


def _shifts() -> np.ndarray:
    """The least shift that brings places i and j into the sample, by i mod T and j mod T."""
    inside = np.isin(np.arange(T), COVER)
    i, j, s = np.ogrid[:T, :T, :T]
    return np.argmax(inside[(i + s) % T] & inside[(j + s) % T], axis=2)


_SHIFT = _shifts()


class Extensions:
    """Longest common extensions to the right of pairs of places in texts that lie end to end.

    `word` holds small numbers; every text is followed by a number that occurs
    once.  `owner` is the text of each place, -1 for those separators.
    """

    def __init__(self, word: np.ndarray, owner: np.ndarray):
        self.word, self.owner = word, owner
        self.sorted_texts = np.zeros(int(owner.max(initial=-1)) + 1, bool)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For i < j of one text: words that agree before the sample is reached, and whether it is reached."""
        shift = _SHIFT[i % T, j % T]
        agreed = np.zeros(len(i), np.int64)
        live = np.flatnonzero(shift > 0)
        for c in range(int(shift.max(initial=0))):
            live = live[self.word[i[live] + c] == self.word[j[live] + c]]
            agreed[live] = c + 1
            live = live[shift[live] > c + 1]
        return agreed, agreed == shift

    def far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from places of the sample on (0 where a place is a separator)."""
        out = np.zeros(len(i), np.int64)
        some = np.flatnonzero(self.owner[j] >= 0)
        texts = np.unique(self.owner[i[some]])
        if not self.sorted_texts[texts].all():
            self.sorted_texts[texts] = True
            self._sort()
        if len(some):
            a, b = self.rank[self.slot[i[some]]], self.rank[self.slot[j[some]]]
            low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                at = np.flatnonzero(level == k)
                out[some[at]] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out

    def _sort(self) -> None:
        """Rank the sampled suffixes of the texts wanted so far, and tabulate the common prefixes of neighbours."""
        n = len(self.word)
        wanted = np.append(self.sorted_texts, False)[self.owner]  # separators: False
        place = np.flatnonzero(wanted & np.isin(np.arange(n) % T, COVER))
        self.slot = np.full(n, -1, np.int64)
        self.slot[place] = np.arange(len(place))
        m = len(place)
        # blocks of T words, as many words at once as fit beside a rank
        word = np.append(self.word, np.zeros(T, self.word.dtype)).astype(np.int64)
        width = int(self.word.max(initial=0)).bit_length()
        together = max(1, (62 - max(1, m).bit_length()) // max(1, width))
        rank = self.owner[place].astype(np.int64)
        for first in range(0, T, together):
            key = rank
            for c in range(first, min(T, first + together)):
                key = (key << width) | word[place + c]
            _, rank = np.unique(key, return_inverse=True)
        steps, size = [rank], T
        while m and rank.max() < m - 1:
            rank = np.unique(rank * (m + 1) + self._next(rank, place, size), return_inverse=True)[1]
            steps.append(rank)
            size *= 2
        self.rank = rank
        order = place[np.argsort(rank)]
        common = np.zeros(m, np.int64)
        before, after = order[:-1], order[1:]
        same = np.append(self.owner, -1)[before] == self.owner[after]
        for step in reversed(steps[:-1] if len(steps) > 1 else []):
            size //= 2
            a, b = (self.slot[np.minimum(x + common[1:], n - 1)] for x in (before, after))
            common[1:] += size * (same & (a >= 0) & (b >= 0) & (step[a] == step[b]))
        live = np.flatnonzero(same)
        for c in range(T):
            live = live[self.word[before[live] + common[1:][live]] == self.word[after[live] + common[1:][live]]]
            common[1:][live] += 1
        self.least = [common]
        while 2 << (len(self.least) - 1) <= m:
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def _next(self, rank: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """Rank of the suffix `size` words on, from 1; 0 where there is none."""
        at = self.slot[np.minimum(place + size, len(self.word) - 1)]
        return np.where(at >= 0, rank[at] + 1, 0)


def _laid(texts: list[np.ndarray], kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of word numbers end to end, with a number of its own before, between and after them; owners; starts."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size
    owner = np.full(int(size.sum()) + len(texts) + 1, -1, np.int64)
    inside = np.arange(size.sum()) + np.repeat(np.arange(1, len(texts) + 1), size)
    owner[inside] = np.repeat(np.arange(len(texts)), size)
    word = np.empty(len(owner), np.int64)
    word[owner < 0] = kinds + np.arange(len(texts) + 1)
    if len(inside):
        word[inside] = np.concatenate(texts)
    return word, owner, begin


def runs(texts: list[np.ndarray], kinds: int, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> np.ndarray:
    """(text, start, period, end) of all runs of texts given as word numbers under `kinds`, ordered; starts count from 0 in each text."""
    word, owner, begin = _laid(texts, kinds)
    last = len(word) - 1
    right, left = Extensions(word, owner), Extensions(word[::-1], owner[::-1])
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    periods = np.where(size >= least_words, size // least_times, 0)
    text = np.repeat(np.arange(len(texts)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    width = np.maximum(least_words, least_times * period) - period
    count = -(-(size[text] - period) // width)
    total = np.concatenate([[0], np.cumsum(count)])
    found = [np.empty((0, 4), np.int64)]
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + GRID, side="right")) - 1)
        row = np.repeat(np.arange(at, stop), count[at:stop])
        p, w = period[row], width[row]
        i = begin[text[row]] + (np.arange(len(row)) + total[at] - total[row]) * w
        hit = word[i] == word[i + p]
        i, p, w = i[hit], p[hit], w[hit]
        ahead, ahead_open = right.near(i, i + p)
        behind, behind_open = left.near(last - (i + p - 1), last - (i - 1))
        able = ahead_open | behind_open | (ahead + behind >= w)
        i, p, w, ahead, ahead_open, behind, behind_open = (x[able] for x in (i, p, w, ahead, ahead_open, behind, behind_open))
        open_ = np.flatnonzero(ahead_open)
        ahead[open_] += right.far(i[open_] + ahead[open_], i[open_] + p[open_] + ahead[open_])
        open_ = np.flatnonzero(behind_open)
        behind[open_] += left.far(last - (i + p - 1)[open_] + behind[open_], last - (i - 1)[open_] + behind[open_])
        good = ahead + behind >= w
        i, p, ahead, behind = i[good], p[good], ahead[good], behind[good]
        d = owner[i]
        found.append(_least_periods(np.stack([d, i - behind - begin[d], p, i + ahead + p - begin[d]], axis=1)))
        at = stop
    return _least_periods(np.concatenate(found))


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """Of the rows (text, start, period, end) of one stretch that of the least period; ordered by text, start, period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 3], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, [0, 1, 3]] != rows[:-1, [0, 1, 3]]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def text_runs(texts: list[str]) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Runs of the texts' words, their numbers of words, and the texts without what runs repeat."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # at space, tab, newlines and feeds
    number = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(words)))}
    found = runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words], len(number))
    drop: dict[int, np.ndarray] = {}
    for d, start, period, end in found.tolist():
        drop.setdefault(d, np.zeros(len(words[d]), bool))[start + period : end] = True
    kept = [itertools.compress(w, (~drop[d]).tolist()) if d in drop else w for d, w in enumerate(words)]
    return found, [len(w) for w in words], [b" ".join(w) for w in kept]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row.

    The collapsed text lacks each word that some run contains after its first period.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for b, texts in parts(batch, 1, SLICE_BYTES):
                found, n, collapsed = text_runs(texts)
                at = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
                each = pa.StructArray.from_arrays([pa.array(x) for x in (found[:, 1], found[:, 3] - found[:, 1], found[:, 2])], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), each), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
