"""Vectorised text primitives shared by the operators (numpy, inside tasks).

Texts of a batch are laid end to end as UTF-32 code points.  Words and other
runs are found with array comparisons, and every run gets a 64-bit
hash from prefix sums, so no Python loop touches single characters.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE, MARK = 0, 1, 2, 3, 4
#: Code points of one slice of a batch; keeps a task's arrays at tens of MB.
SLICE_CHARS = 250_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: equal inputs, equal outputs; bits spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1)."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _kind(ch: str) -> int:
    cat = unicodedata.category(ch)
    if ch.isspace() and ch not in "\x1c\x1d\x1e\x1f":
        return SPACE
    return {"L": LETTER, "N": NUMBER, "M": MARK}.get(cat[0], OTHER)


@functools.lru_cache(1)
def _kinds() -> np.ndarray:
    return np.array([_kind(chr(i)) for i in range(0x10000)], np.uint8)


@functools.lru_cache(1)
def _char_hashes() -> np.ndarray:
    return mix(np.arange(1, 0x10001, dtype=np.uint64) * _ODD)


def kinds_of(cp: np.ndarray) -> np.ndarray:
    """OTHER, LETTER, NUMBER, SPACE or MARK of each code point."""
    out = _kinds()[np.minimum(cp, 0xFFFF)]
    far = np.flatnonzero(cp > 0xFFFF)
    if len(far):
        values, at = np.unique(cp[far], return_inverse=True)
        out[far] = np.array([_kind(chr(int(v))) for v in values], np.uint8)[at]
    return out


#: Powers of more places than this are not kept.
_KEPT = 1 << 19


@functools.lru_cache(8)
def _kept_powers(n: int, base: int, prime: bool) -> np.ndarray:
    return _prime_powers(n, base) if prime else _powers(n, base)


def powers(n: int, base: int, prime: bool) -> np.ndarray:
    return _kept_powers(n, base, prime) if n <= _KEPT else _kept_powers.__wrapped__(n, base, prime)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n + 1, np.uint64(base), np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


#: A second hash is taken modulo this prime: sums modulo 2^64 alone are equal for some regular words of two letters.
_PRIME, _BASE = np.uint64(2**31 - 1), 1_234_567_891


def _prime_powers(n: int, base: int) -> np.ndarray:
    p = np.ones(1, np.uint64)
    step = base
    while len(p) <= n:
        p = np.concatenate([p, p * np.uint64(step) % _PRIME])
        step = step * step % int(_PRIME)
    return p


class RunHasher:
    """Hashes of arbitrary code point ranges of one slice."""

    def __init__(self, cp: np.ndarray):
        n = 1 << max(10, int(len(cp)).bit_length())
        h = _char_hashes()[np.minimum(cp, 0xFFFF)]
        far = cp > 0xFFFF
        if far.any():
            h[far] = mix((cp[far].astype(np.uint64) + np.uint64(1)) * _ODD)
        self._second = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((h >> np.uint64(33)) * powers(n, _BASE, True)[: len(cp)] % _PRIME, out=self._second[1:])
        h *= powers(n, int(_ODD), False)[: len(cp)]
        self._sum = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(h, out=self._sum[1:])
        self._inv = powers(n, int(_INV), False)
        self._back = powers(n, pow(_BASE, -1, int(_PRIME)), True)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        first = (self._sum[end] - self._sum[start]) * self._inv[start] + (end - start).astype(np.uint64)
        second = (self._second[end] - self._second[start]) % _PRIME * self._back[start] % _PRIME
        return mix(mix(first) + second)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and where each text begins (one more entry than texts)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def slices(texts: Sequence[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) in runs of at most `limit` code points; a longer text stands alone. Null is empty."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > limit:
            yield first, held
            first, size, held = i, 0, []
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def parts(batch: pa.RecordBatch, column: int, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in runs of rows of at most `limit` bytes of text, with the run's texts; a longer text stands alone. Null is empty.

    Only one run is held as Python strings at a time, so a task's memory does not follow Spark's batch size.
    """
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        run = batch.slice(at, stop - at)
        yield run, [t or "" for t in run.column(column).to_pylist()]
        at = stop


def words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words (runs of letters, marks and numbers).

    Returns (hash, text index, start, end, code points); starts and ends count
    code points of the joined lower-cased texts.
    """
    cp, at = code_points([t.lower() for t in texts])
    kind = kinds_of(cp)
    inside = (kind == LETTER) | (kind == NUMBER) | (kind == MARK)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][np.diff(at) > 0]
    begins[heads] = inside[heads]
    start = np.flatnonzero(begins)
    stops = np.zeros(len(cp) + 1, bool)
    stops[1:] = inside
    after = np.zeros(len(cp) + 1, bool)
    after[:-1] = begins | ~inside
    after[-1] = True
    end = np.flatnonzero(stops & after)
    doc = np.searchsorted(at, start, side="right") - 1
    return RunHasher(cp)(start, end), doc, start, end, cp


def spans(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets by text of rows that are ordered by text (n + 1 entries)."""
    return np.searchsorted(doc, np.arange(n + 1))


def shingles(h: np.ndarray, doc: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside each text, and their text; a text of fewer words gives one shingle of all."""
    if not len(h):
        return h, doc
    total = np.zeros(len(h) + k - 1, np.uint64)
    padded = np.concatenate([h, np.zeros(k - 1, np.uint64)])
    own = np.concatenate([doc, np.full(k - 1, -1)])
    mult = [mix(np.array([i + 77], np.uint64))[0] | np.uint64(1) for i in range(k)]
    m = len(h)
    total = total[:m]
    for i in range(k):
        same = own[i : i + m] == doc
        total += np.where(same, (padded[i : i + m] + np.uint64(i + 1)) * mult[i], np.uint64(0))
    at = spans(doc, n)
    count = np.diff(at)
    keep = np.arange(m) < (at[1:][doc] - k + 1)
    keep[at[:-1][(count > 0) & (count < k)]] = True
    return mix(total[keep]), doc[keep]
