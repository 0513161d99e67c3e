"""Collocations by dynamic itemset counting over shards of the documents.

Texts are split into pieces and those into words; everything is counted by
language.  The documents are dealt into `SHARDS` shards once, which are scanned
in a cycle.  A scan counts phrases of all lengths side by side: words from the
first scan on, and a longer phrase from the scan after both of its subphrases
(all words but the last, all but the first) have reached the threshold.  When a
phrase has been counted in every shard, one full cycle after it began, its count
is exact and it leaves the scans; they end when nothing is being counted.

Which subphrases have reached the threshold, and after which scan, is broadcast
as a table of fixed size (`SLOTS` bytes) in which a phrase's hash picks a slot
and the first entry stays.  It only decides where counting begins: phrases that
share a slot may begin too early, but never before both subphrases have begun, and
still go through exactly one full cycle.
So counts do not depend on it.  Phrases themselves are told apart by their
characters; inside one slice of text, words by 64-bit hashes.

A phrase's score is that of its weakest cut: floor(1000 * a * n / (l * r)) for
its own count a, its parts' counts l and r and the language's n words, in exact
arithmetic.  A phrase held in a longer one that occurs as often is left out;
since counts never grow with length, it is enough to look one word further.

A null text is empty, a null language is `und`.  Repeated rows count each time,
ids may be null.  Ties of cuts fall to the first cut, of ranks to the count,
then to the phrase in byte order.  An empty table gives no rows; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import erase, written
from .text import mix, parts

LONGEST, THRESHOLD, MOST, SHARDS = 5, 100, 2000, 3
#: Slots of the broadcast table of phrases that have reached the threshold (one byte each).
SLOTS = 1 << 23
#: Bytes of text counted together.
SLICE_BYTES = 1_000_000
NEVER = 255
_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A phrase and the scan it began with; its count so far, and in the last scan.
KEYS = ["lang", "phrase", "length", "began", "hash"]
STATE = "lang string, phrase string, length int, began int, hash long, total long, fresh long"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of all texts, each with one blank behind it, as bytes; the length, piece and text of each word."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    whole = np.frombuffer(b"\n".join([*raw, b""]).translate(_LOWER), np.uint8)
    kind = _KIND[whole]
    inside = kind == _WORD
    after = np.zeros(len(whole), bool)  # the place behind each word
    after[1:] = inside[:-1] & ~inside[1:]
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if len(inside) and inside[0]:
        start = np.concatenate([[0], start])
    joined = np.where(after, np.uint8(32), whole)[inside | after]
    first = np.zeros(len(start) + 1, np.int64)  # whether a piece begins with a word
    np.add.at(first, np.searchsorted(start, np.flatnonzero(kind == _BREAK)), 1)
    begin = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    return joined, np.flatnonzero(after) - start, np.cumsum(first)[:-1], np.searchsorted(begin, start, side="right") - 1


def hashes(joined: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of the bytes, eight bytes at a time."""
    out = mix(size.astype(np.uint64) * _STEP)
    padded = np.concatenate([joined, np.zeros(8, np.uint8)])
    live, at = np.arange(len(start)), 0
    while len(live := live[size[live] > at]):
        chunk = padded[(start[live] + at)[:, None] + np.arange(8)].view("<u8").ravel()
        rest = np.minimum(size[live] - at, 8).astype(np.uint64)
        chunk &= ~np.uint64(0) >> (np.uint64(64) - rest * np.uint64(8))
        out[live] = mix((out[live] ^ chunk) * _STEP + np.uint64(1))
        at += 8
    return out


def _phrases(joined: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The parts of the joined words from `start` to `end` as strings."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    data = joined[np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def slot(phrase: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The slot of each phrase hash; `slots` is a power of two."""
    return (phrase >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def scan(texts: list[str], langs: list[str], reached: np.ndarray, now: int, shards: int, longest: int) -> list[tuple]:
    """What scan number `now` counts, a tuple of arrays for each length: (length, begin, phrase hash, count, first word, language); before them, the joined words, their starts and ends, and the languages' names."""
    joined, size, piece, text = words(texts)
    if not len(size):
        return []
    names = {name: i for i, name in enumerate(dict.fromkeys(langs))}
    lang = np.fromiter(map(names.__getitem__, langs), np.int64, len(langs))[text]
    spelt = [n.encode("utf-8", "surrogatepass") for n in names]
    length = np.fromiter(map(len, spelt), np.int64, len(spelt))
    salt = hashes(np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(length) - length, length)
    start = np.cumsum(size + 1) - size - 1
    word = hashes(joined, start, size)
    place = np.arange(len(size))
    phrase = mix(word * _STEP + salt[lang])
    began = np.zeros(len(size), np.int64)
    found: list[tuple] = [(joined, start, start + size, list(names))]
    for k in range(1, longest + 1):
        counted = np.flatnonzero((began <= now) & (now < began + shards))
        if len(counted):
            key, first, n = np.unique(phrase[counted], return_index=True, return_counts=True)
            first = counted[first]
            found.append((k, began[first], key, n, place[first], lang[place[first]]))
        if k == longest:
            break
        # both subphrases must have reached the threshold: those at neighbouring places, inside one piece
        since = reached[slot(phrase, len(reached))]
        able = np.flatnonzero(since != NEVER)
        next_ = able[:-1][(place[able[1:]] == place[able[:-1]] + 1) & (piece[np.minimum(place[able[:-1]] + k, len(piece) - 1)] == piece[place[able[:-1]]])]
        # and it can be met only once they are themselves: words that share no slot may have been later than their phrase's slot
        ready = np.maximum(began, 1 + since.astype(np.int64))
        began = np.maximum(ready[next_], ready[next_ + 1])
        place, phrase = place[next_], mix(phrase[next_] * _STEP + word[place[next_] + k])
        if not len(place):
            break
    return found


def counts(docs: DataFrame, reached: np.ndarray, now: int, shards: int, longest: int) -> DataFrame:
    """lang, phrase, length, began, hash, n of the phrases that scan number `now` counts in (lang, text) rows, by slice."""
    table = docs.sparkSession.sparkContext.broadcast(reached)

    def run(batches):
        for batch in batches:
            for b, texts in parts(batch, 1, SLICE_BYTES):
                got = scan(texts, b.column(0).to_pylist(), table.value, now, shards, longest)
                if len(got) < 2:
                    continue
                joined, start, end, names = got[0]
                for k, began, key, n, first, lang in got[1:]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()).take(pa.array(lang)), _phrases(joined, start[first], end[first + k - 1]), pa.array(np.full(len(key), k, np.int32)), pa.array(began.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(n)],
                        ["lang", "phrase", "length", "began", "hash", "n"],
                    )

    return docs.mapInArrow(run, "lang string, phrase string, length int, began int, hash long, n long")


def frequent(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, a) of all phrases of up to `longest` words that occur `threshold` times or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    dealt = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.pmod(F.xxhash64(doc_id, text), F.lit(shards)).cast("int").alias("shard"))
    dealt = written(dealt, "shards", "shard")
    reached = np.full(slots, NEVER, np.uint8)
    going, whole = spark.createDataFrame([], STATE), []
    now, last = 0, -1
    while now <= last + shards and now < NEVER:
        new = counts(dealt.where(F.col("shard") == now % shards).select("lang", "text"), reached, now, shards, longest).withColumn("old", F.lit(0).cast("long"))
        held = going.where(F.col("began") + shards > now).select(*KEYS, F.lit(0).cast("long").alias("n"), F.col("total").alias("old"))
        state = written(new.unionByName(held).groupBy(*KEYS).agg(F.sum(F.col("n") + F.col("old")).alias("total"), F.sum("n").alias("fresh")), "phrases")
        if now:
            erase(going)
        going = state
        # at most one number a slot comes to the driver
        crossed = state.where((F.col("total") >= threshold) & (F.col("total") - F.col("fresh") < threshold) & (F.col("length") < longest))
        fresh = crossed.select(F.shiftrightunsigned("hash", 65 - slots.bit_length()).alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)
        if len(fresh):
            last = now
            reached[fresh] = np.minimum(reached[fresh], now)
        if now >= shards - 1:  # what began `shards` scans ago has been counted in every shard
            done = state.where((F.col("began") + shards - 1 == now) & ((F.col("total") >= threshold) | (F.col("length") == 1)))
            whole.append(written(done.select("lang", "phrase", "length", F.col("total").alias("a")), "counted"))
        now += 1
    erase(going, dealt)
    found = reduce(DataFrame.union, whole).where(F.col("a") >= threshold)
    # each word's count is complete with the first cycle
    return found, whole[0].where("length = 1").groupBy("lang").agg(F.sum("a").alias("n"))


def cuts(found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Each phrase of two words or more with its two parts, cut after k words."""
    at = F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    both = found.where("length > 1").select("lang", "phrase", "length", "a", at)
    left = F.expr("substring_index(phrase, ' ', k)")
    right = F.expr("substring_index(phrase, ' ', k - length)")
    return both.select("lang", "phrase", "length", "a", "k", left.alias("left"), right.alias("right"))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, most: int = MOST, shards: int = SHARDS, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, k of each language's `most` best phrases of 2 to `longest` words."""
    found, size = frequent(docs, threshold, longest, shards, slots, doc_id, text, lang)
    size = written(size, "words")
    part = lambda side, n: found.select("lang", F.col("phrase").alias(side), F.col("a").alias(n))
    cut = cuts(found, longest).join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cut = cut.join(F.broadcast(size) if size.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else size, "lang")
    cut = cut.withColumn("over", wide("a") * F.lit(1000).cast("decimal(4,0)") * wide("n")).withColumn("under", wide("l") * wide("r")).withColumn("score", F.expr("over div under"))
    worst = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("w"), F.first("length").alias("length"))
    longer = found.where("length > 2")
    inner = longer.select("lang", F.expr("substring_index(phrase, ' ', length - 1)").alias("phrase"), "a").unionByName(longer.select("lang", F.expr("substring_index(phrase, ' ', 1 - length)").alias("phrase"), "a"))
    kept = worst.join(inner, ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("w.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").alias("score"), F.col("w.k").alias("k"))


#: Languages up to which their sizes are broadcast.
BROADCAST_LANGS = 10_000


def sql(table: str = "documents", threshold: int = THRESHOLD, most: int = MOST) -> str:
    """DuckDB SQL for the query's columns of collocations() with up to five words."""
    return f"""
    WITH p AS (SELECT lang, row_number() OVER () AS piece, words FROM (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS words FROM {table}) WHERE len(words) > 0),
    g AS (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM p, range(1, 6) t(k) WHERE len(words) >= k),
    f AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {threshold} OR k = 1),
    n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY 1),
    c AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND a >= {threshold}),
    s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
          FROM c JOIN n ON n.lang = c.lang
          JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1 : c.cut], ' ')
          JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[c.cut + 1 :], ' ')),
    w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    o AS (SELECT DISTINCT lang, a, array_to_string(string_split(phrase, ' ')[x : x + k - 2], ' ') AS phrase FROM c, range(1, 3) t(x) WHERE k > 2),
    d AS (SELECT * FROM w ANTI JOIN o ON o.lang = w.lang AND o.phrase = w.phrase AND o.a = w.a),
    z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d)
    SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z WHERE rank <= {most}"""
