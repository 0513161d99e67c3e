import hashlib
import random

import numpy as np
from leadlake.llm import fingerprint as fp


def plain_likeness(x, y):
    if x == y:
        return 1.0
    if not any(x[i : i + fp.RUN] in y for i in range(len(x) - fp.RUN + 1)):
        return 0.0
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return 2 * row[-1] / (len(x) + len(y))


def plain(a, b):
    if a == b:
        return 1.0
    ka, a1, a2 = a.split(":")
    kb, b1, b2 = b.split(":")
    pairs = {0: [(a1, b1), (a2, b2)], 1: [(a1, b2)], -1: [(a2, b1)]}.get(int(ka) - int(kb), [])
    return max([plain_likeness(x, y) for x, y in pairs if x and y], default=0.0)


def plain_fingerprint(text):
    raw = text.encode()
    marks = []
    for i in range(len(raw)):
        h = 0
        for j in range(8):
            if i - j >= 0:
                h += int(fp._BYTES[raw[i - j]]) * pow(0x01000193, j, 1 << 32)
        h &= 0xFFFFFFFF
        h ^= h >> 16
        h = h * 0x7FEB352D & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x846CA68B & 0xFFFFFFFF
        marks.append(h ^ (h >> 16))
    zeros = lambda h: 32 if h == 0 else (h & -h).bit_length() - 1
    k = 2
    while sum(zeros(h) >= k for h in marks) >= 64 and k < 31:
        k += 1

    def part(level):
        out, run = "", []
        for i, h in enumerate(marks):
            run.append(h)
            if zeros(h) >= level or i == len(marks) - 1:
                x = np.array([(sum(run) + len(run)) % 2**64], np.uint64)
                out += chr(fp.ALPHABET[int(fp.mix(x)[0]) & 63])
                run = []
        return out

    return f"{k}:{part(k)}:{part(k + 1)}"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé ñ") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_fingerprints_match_a_plain_version():
    rng = random.Random(3)
    texts = ["", "a", "abc" * 5, *(words(rng, n) for n in (1, 5, 40, 200, 900))]
    assert fp.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_likeness_matches_plain_edit_distance():
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 300)) for _ in range(60)]
    left = base + base
    right = [fp.edit(a, b) for a, b in zip(base, base[1:] + base[:1])] + base[1:] + base[:1]
    a, b = fp.fingerprints(left), fp.fingerprints(right)
    assert np.allclose(fp.likeness(a, b), [plain(x, y) for x, y in zip(a, b)])


def test_edit_keeps_the_front_and_takes_the_next_front():
    assert fp.edit("abcde", "XYZW") == "abcXY"
    assert fp.edit("abcde", "") == "abc"
    assert fp.edit("", "zz") == ""


def test_neighbours_over_partitions(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(0, 60)), "x") for i in rng.sample(range(1000), 90)]
    rows += [(rows[0][0], rows[0][1], "x"), (rows[1][0], "other", "y"), (None, None, None), (2000, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string").repartition(7)
    got = fp.neighbours(df).collect()
    h = {r.text: r.h for r in df.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]], r[1]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        changed = fp.edit(t, nxt)
        a, b, c = fp.fingerprints([t, changed, nxt])
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, plain(a, b), plain(a, c)))
    key = lambda r: (str(r[0]), r[2], r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert fp.neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
