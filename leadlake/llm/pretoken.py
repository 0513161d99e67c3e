"""Byte-level BPE over whole columns: pre-tokens by array operations, ids by two-tier lookup.

The pre-token rule is the one of the vocabulary file (contractions, an optional
space before letters, numbers or other marks, runs of white space); BPE never
crosses pre-tokens, so the ids of a text are the ids of its pre-tokens in order.
Both tiers are hash tables keyed by a pre-token's characters.  Tier one is built
once on the driver and broadcast; tier two is a cache in each Python worker that
grows with what that worker has met.  Hashes only bring equal pre-tokens of a
slice together: each is compared with the one that is looked up.  Texts with rare
code points, a special string, or two pre-tokens of one hash go to the library
whole; long texts go in pieces that end where a pre-token does.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from codecs import utf_16_le_decode
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from .text import LETTER, MARK, NUMBER, OTHER, SLICE_CHARS, SPACE, RunHasher, code_points, kinds_of, slices

#: Entries of the cache of one worker before it begins anew.
CACHE_ENTRIES = 200_000


@functools.lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(2)
def sentence_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(2)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(x["content"] for x in json.load(open(path, encoding="utf-8"))["added_tokens"])


@functools.lru_cache(2)
def is_plain_byte_bpe(path: str) -> bool:
    """Whether the file is byte-level BPE without normaliser or prefix space, as the fast path needs."""
    if not path.endswith(".json"):
        return False
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    return bool(pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges"))


@functools.lru_cache(2)
def _encode_piece(path: str):
    """bytes of one pre-token -> ids. Merge ranks are the ids, checked on the file's own merges."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    code = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    special = set(special_strings(path))
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
    ranks = {bytes(code[c] for c in k): v for k, v in vocab.items()}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    order = [vocab[m] for m in merges]
    if order != sorted(order) or len(ranks) != len(vocab):
        slow = tokenizer(path)
        return lambda piece: slow.encode(piece.decode("utf-8"), add_special_tokens=False).ids
    return tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


@functools.lru_cache(1)
def _settled() -> np.ndarray:
    """BMP code points whose class every Unicode version since 3.2 agrees on."""
    old = unicodedata.ucd_3_2_0
    group = lambda db, c: db.category(c)[0]
    return np.array([0xD800 > i or i > 0xDFFF for i in range(0x10000)]) & np.array([(g := group(old, c := chr(i))) == group(unicodedata, c) and old.category(c) != "Cn" or False for i in range(0x10000)])


def split(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every pre-token, code points, and which texts must go to the library whole."""
    cp, at = code_points(texts)
    n = len(cp)
    odd = np.zeros(len(texts), bool)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, cp, odd
    strange = np.flatnonzero((cp > 0xFFFF) | ~_settled()[np.minimum(cp, 0xFFFF)])
    if len(strange):
        odd[np.searchsorted(at, strange, side="right") - 1] = True
    kind = kinds_of(cp)
    kind[kind == MARK] = OTHER
    first = np.zeros(n + 1, bool)
    first[at[:-1][np.diff(at) > 0]] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    cut = run.copy()
    # the last white space before other text: a blank joins what follows, any other stands alone
    follows = np.flatnonzero(run[1:n] & ~first[1:n] & (kind[:-1] == SPACE)) + 1
    cut[follows - 1] = True
    blank = follows[cp[follows - 1] == 0x20]
    cut[blank] = False
    # contractions: an apostrophe that begins a pre-token and is a run alone
    quote = np.flatnonzero(run[:n] & cut[:n] & (cp == 0x27))
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        a = cp[quote + 1]
        b = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        b[first[np.minimum(quote + 2, n)]] = 0
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        length = np.where(one, 1, np.where(two, 2, 0))
        q, k = quote[length > 0], length[length > 0]
        cut[q + 1] = False
        stop = q + 1 + k
        cut[stop] = True
    start = np.flatnonzero(cut[:n])
    end = np.append(start[1:], n)
    return start, end, np.searchsorted(at, start, side="right") - 1, cp, odd


@dataclass
class Table:
    """Frequent pre-tokens, compact: their UTF-16 characters end to end, their lengths, id counts and (if wanted) ids."""

    chars: bytes
    lengths: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray

    @property
    def mark(self) -> tuple:
        return len(self.lengths), len(self.ids), zlib.crc32(self.chars)


NO_TABLE = Table(b"", np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32))


class Lookup:
    """Pre-token -> ids, in two tiers of hash tables that are keyed by the characters themselves.

    A pre-token's value is the place of its first id (high half) and their count
    (low half).  Ids of both tiers lie in one array, the table's first.
    """

    def __init__(self, path: str, table: Table = NO_TABLE, ids: bool = True):
        self.path, self.keep = path, ids
        stop = (2 * np.cumsum(table.lengths, dtype=np.int64)).tolist()
        value = table.sizes.astype(np.int64)
        if ids:
            value = ((np.cumsum(value) - value) << 32) | value
        self.first = {table.chars[a:b]: v for a, b, v in zip([0, *stop], stop, value.tolist(), strict=False)}
        self.base = len(table.ids)
        self.ids = np.concatenate([table.ids, np.zeros(1 << 16, np.uint32)])
        self.clear()

    def clear(self) -> None:
        self.second: dict[bytes, int] = {}
        self.used = self.base

    def _learn(self, key: bytes) -> int:
        found = _encode_piece(self.path)(utf_16_le_decode(key)[0].encode())
        value = len(found)
        if self.keep:
            if self.used + value > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(value, len(self.ids)), np.uint32)])
            self.ids[self.used : self.used + value] = found
            value |= self.used << 32
            self.used += len(found)
        self.second[key] = value
        return value

    def __call__(self, start: np.ndarray, end: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id count, place of the first id, whether another pre-token has its hash) of each pre-token.

        Pre-tokens of one hash are looked up once; each is compared with that one
        character by character, and those that differ must not use the answer.
        """
        if len(self.second) > CACHE_ENTRIES:
            self.clear()
        _, first, inverse = np.unique(RunHasher(cp)(start, end), return_index=True, return_inverse=True)
        raw = cp.astype("<u2").tobytes()
        one, two, value = self.first.get, self.second.get, np.empty(len(first), np.int64)
        for i, (a, b) in enumerate(zip((2 * start[first]).tolist(), (2 * end[first]).tolist(), strict=True)):
            key = raw[a:b]
            found = one(key)
            if found is None:
                found = two(key)
                if found is None:
                    found = self._learn(key)
            value[i] = found
        value = value[inverse]
        return value & 0xFFFFFFFF, value >> 32, differing(cp, start, end, first[inverse])

    def gather(self, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """All ids of the pre-tokens, in order."""
        head = np.cumsum(size) - size
        return self.ids[np.arange(int(size.sum())) + np.repeat(at - head, size)]


def differing(cp: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whether each run of code points differs from the run `like` (an index)."""
    length = end - start
    out = length != length[like]
    head = np.cumsum(length) - length
    at = np.arange(int(length.sum()))
    other = np.minimum(at + np.repeat(start[like] - head, length), max(0, len(cp) - 1))
    unlike = cp[at + np.repeat(start - head, length)] != cp[other]
    if unlike.any():
        out = out.copy()
        out[np.repeat(np.arange(len(length)), length)[unlike]] = True
    return out


_CUT = re.compile(r"[A-Za-z0-9] ")


def segments(texts: Sequence[str], limit: int = SLICE_CHARS) -> tuple[list[str], np.ndarray]:
    """The texts in pieces of about `limit` characters at most, and the text of each piece.

    A text is cut only between an ASCII letter or digit and a blank, where a
    pre-token always ends, so that the pieces' ids are the text's ids in order.
    """
    out, owner = [], []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > limit:
            cut = t.rfind(" ", at + 2, at + limit)
            while cut > 0 and not _CUT.match(t, cut - 1):
                cut = t.rfind(" ", at + 2, cut)
            if cut < 0:
                found = _CUT.search(t, at + limit)
                if not found:
                    break
                cut = found.start() + 1
            out.append(t[at:cut])
            owner.append(i)
            at = cut
        out.append(t[at:])
        owner.append(i)
    return out, np.array(owner, np.int64)


_lookups: dict[tuple, Lookup] = {}


def worker_lookup(path: str, table: Table, ids: bool) -> Lookup:
    """The worker's lookup; its second tier lives as long as the worker does."""
    mark = (path, ids, *table.mark)
    if mark not in _lookups:
        _lookups.clear()
        _lookups[mark] = Lookup(path, table, ids)
    return _lookups[mark]


def encoded(texts: Sequence[str | None], path: str, table: Table, ids: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, its piece's id count, the piece's ids) of every piece of the texts, in order; without `ids` only counts."""
    whole, lookup = tokenizer(path), worker_lookup(path, table, ids)
    pieces, owner = segments([t or "" for t in texts])
    none = np.zeros(0, np.uint32)
    for at, part in slices(pieces):
        start, end, doc, cp, odd = split(part)
        odd = must_go_whole(part, odd, path)
        use = ~odd[doc]
        doc = doc[use]
        size, place, other = lookup(start[use], end[use], cp)
        if other.any():
            odd[doc[other]] = True
            use = ~odd[doc]
            doc, size, place = doc[use], size[use], place[use]
        flat = lookup.gather(size, place) if ids else none
        count = np.bincount(doc, size, len(part)).astype(np.int64)
        stop = np.cumsum(count)
        for i, t in enumerate(part):
            if odd[i]:
                own = np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32)
                yield int(owner[at + i]), len(own), own
            else:
                yield int(owner[at + i]), int(count[i]), flat[stop[i] - count[i] : stop[i]] if ids else none


def frequent(texts: Sequence[str], path: str, entries: int, ids: bool) -> Table:
    """The most frequent pre-tokens of some texts."""
    times: Counter[bytes] = Counter()
    for _, part in slices(segments(texts)[0]):
        start, end, doc, cp, odd = split(part)
        use = ~odd[doc]
        raw = cp.astype("<u2").tobytes()
        times.update(raw[a:b] for a, b in zip((2 * start[use]).tolist(), (2 * end[use]).tolist(), strict=True))
    top = [k for k, _ in times.most_common(entries)]
    found = [_encode_piece(path)(k.decode("utf-16-le").encode()) for k in top]
    flat = np.fromiter((i for f in found for i in f), np.uint32) if ids else np.zeros(0, np.uint32)
    return Table(b"".join(top), np.array([len(k) // 2 for k in top], np.int32), np.array([len(f) for f in found], np.int32), flat)


def must_go_whole(texts: Sequence[str], odd: np.ndarray, path: str) -> np.ndarray:
    special = special_strings(path)
    return odd | np.fromiter((any(s in t for s in special) for t in texts), bool, len(texts))
