"""Kernels of the classifiers against plain loops."""

import math
import random

import numpy as np

from leadlake.llm import quality, toxicity


def plain_logit(chunk, p):
    """One chunk's logit, filter by filter and place by place."""
    answers = []
    for f in range(p["filter"].shape[1]):
        best = -math.inf
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            patch = np.concatenate([p["embed"][b] for b in chunk[at : at + quality.WIDTH]])
            best = max(best, float(patch @ p["filter"][:, f]))
        answers.append(max(best + float(p["filter_bias"][f]), 0.0))
    hidden = [math.tanh(sum(a * float(p["dense"][i, j]) for i, a in enumerate(answers)) + float(p["dense_bias"][j])) for j in range(p["dense"].shape[1])]
    return sum(h * float(w) for h, w in zip(hidden, p["out"], strict=True)) + float(p["out_bias"])


def test_convolution_equals_plain_loops():
    rng = np.random.default_rng(1)
    e, f, h = quality.EMBED, 5, 3
    p = {"embed": rng.normal(size=(256, e)), "filter": rng.normal(size=(quality.WIDTH * e, f)), "filter_bias": rng.normal(size=f), "dense": rng.normal(size=(f, h)), "dense_bias": rng.normal(size=h), "out": rng.normal(size=h), "out_bias": np.array(0.25)}
    texts = ["abc", "", None, "é" * 700, "xyz " * 130]
    got = quality.features(texts, p)
    for text, row in zip(texts, got, strict=True):
        raw = (text or "").encode()
        n = max(1, -(-(len(raw) - (quality.CHUNK - quality.STEP)) // quality.STEP))
        logits = [plain_logit(list(raw[i * quality.STEP : i * quality.STEP + quality.CHUNK].ljust(quality.CHUNK, b"\0")), p) for i in range(n)]
        assert np.allclose(row, [min(logits), sum(logits) / n, max(logits), math.log(n)])
    model = quality.Model(p, np.array([0.3, -0.2, 0.1, 0.5, -0.4]))
    want = [1 / (1 + math.exp(-float(np.append(row, 1.0) @ model.combine))) for row in got]
    assert np.allclose(quality.predict(texts, model), want)
    # repeated rows, one of them long, are scored alike
    long = "word " * 20_000
    a, b, c = quality.predict([long, "abc", long], model)
    assert a == c and b == quality.predict(["abc"], model)[0]


def test_word_scores_equal_a_table():
    rng = random.Random(2)
    texts = ["Idiots and friends", "an idiotic, friendly idea", "und so weiter"]
    kinds, *_ = toxicity.token_hashes(texts)
    table = {int(h): rng.choice([-1.5, 0.7, 2.0]) for k in kinds for h in k if h and rng.random() < 0.5}
    keys = np.array(sorted(table), np.uint64)
    model = toxicity.Model(keys, np.array([table[int(k)] for k in keys]), 1.0, 1.0, 0.01)
    want = []
    for j in range(len(kinds[0])):
        own = table.get(int(kinds[0][j]))
        score = toxicity.DRIFT if own is None else own
        for k in kinds[1:]:
            value = table.get(int(k[j])) if k[j] else None
            if value is not None and value > max(score, 0):
                score = value
        want.append(score)
    assert np.allclose(toxicity.word_scores(kinds, model), want)


def test_p_values_equal_the_formula():
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0.8, 0.1, 0.01)
    for scores, n in (([9.0], 100), ([9.0, 8.0, 1.0], 1000), ([2.0], 10_000), ([30.0, 25.0, 20.0], 50)):
        least, total = 1.0, 0.0
        for r, s in enumerate(scores, 1):
            total += model.lam * s - math.log(model.k * n)
            if total <= 0:
                break
            p = 1 - math.exp(-math.exp(-total)) if r == 1 else math.exp(-total) * total ** (r - 1) / (math.factorial(r) * math.factorial(r - 1))
            least = min(least, p, 1.0)
        assert math.isclose(toxicity.p_value(scores[::-1], n, model), max(least, 1e-300), rel_tol=1e-6, abs_tol=1e-12)


def test_segments_of_equal_scores_and_of_a_very_long_text():
    """Maximal segments by definition: no longer stretch has a higher sum, no part of one is left out."""
    rng = random.Random(3)
    for _ in range(50):
        s = np.array([rng.choice([-1.0, -1.0, 1.0, 2.0]) for _ in range(rng.randint(0, 14))])

        def split(low, high):
            """All maximal segments of a stretch: its best part (the shortest of equal ones, the first), then those beside it."""
            best = max(((s[i:j].sum(), -(j - i), -i) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return [*split(low, i), (i, j, best[0]), *split(j, high)]

        assert sum(x[2] for x in toxicity.maximal_segments(s)) == sum(x[2] for x in split(0, len(s)))
    long = np.tile([1.0, -2.0], 200_000)
    assert len(toxicity.maximal_segments(long)) == 200_000
