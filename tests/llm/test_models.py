import itertools
import math
import random
import re
from collections import Counter

import numpy as np
from leadlake.llm import filters, langid, lm, quality, sampling, toxicity

EN, DE = ["the", "and", "shore", "thing", "winter", "lake", "would"], ["der", "und", "schiff", "nicht", "weiter", "kirche", "über"]


def sentence(rng, words, n=9):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


# --- toxicity ----------------------------------------------------------------


def plain_maximal(scores):
    """All maximal segments by their recursive definition."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i = -best[2]
    j = i - best[1]
    left, right = plain_maximal(scores[:i]), plain_maximal(scores[j:])
    return left + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in right]


def test_segments_equal_their_definition():
    rng = random.Random(1)
    for _ in range(300):
        scores = np.array([rng.choice([-3.0, -1.0, -0.5, 1.0, 2.5, 4.0]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 14))])
        got = toxicity.maximal_segments(scores)
        want = plain_maximal(scores.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def toxic_corpus(seed, n=600):
    rng = random.Random(seed)
    bad = ["idiot", "scum", "gluppish", "glupponic", "gluppert", "gluppable"]
    texts, marks = [], []
    for i in range(n):
        body = [sentence(rng, [*EN, f"w{rng.randint(0, 400)}", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(2, 12))]
        toxic = i % 6 == 0
        if toxic:
            body.insert(rng.randrange(len(body)), " ".join(rng.choice(bad) for _ in range(2)) + " you.")
        texts.append(" ".join(body))
        marks.append(toxic)
    return texts, np.array(marks)


def test_toxicity_on_held_out_documents():
    model = toxicity.fit(*toxic_corpus(2))
    texts, marks = toxic_corpus(3)
    scores, found = toxicity.document_scores([*texts, "", None, "... !!!"], model)
    said = np.array(scores[: len(texts)]) >= 0.5
    assert said[marks].mean() > 0.95 and said[~marks].mean() < 0.03
    assert max(scores[len(texts) :]) < 0.01
    text = texts[0].lower()
    assert any(re.search("idiot|scum|glupp", text[a:b]) for a, b, _ in found[0])
    assert toxicity.document_scores(["a glupposition glupped it and gluppered"], model)[0][0] > 0.5  # unseen words of a toxic stem


def test_toxicity_without_labels_says_nothing():
    model = toxicity.fit(["a b c"] * 3, np.zeros(3, bool))
    assert toxicity.document_scores(["idiot scum"], model)[0][0] < 0.01


def test_toxicity_tables(spark):
    texts, marks = toxic_corpus(4, 240)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, None, None), (0, "", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(m)) for i, m in enumerate(marks)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(texts) + 2
    kept = filters.not_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score < 0.5 for r in rows)
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), empty).count() == 0


# --- language-model scoring ----------------------------------------------------


def plain_losses(rows):
    """Losses of each row by the counts of all other rows."""
    words = [re.findall(r"\w+", (t or "").lower()) for _, t, *_ in rows]
    pairs = [list(zip(["^", *w], w)) for w in words]
    loss = {}
    for side in ("target", "background"):
        own = [(g or side == "background") and c for _, _, g, c in rows]
        big, ctx, uni = Counter(), Counter(), Counter()
        for p, o in zip(pairs, own):
            if o:
                big.update(p)
                ctx.update(a for a, _ in p)
                uni.update(b for _, b in p)
        mass = max(1.0, sum(ctx.values()) / max(1, len(ctx)))
        n = sum(uni.values())
        v = len({w for ws, r in zip(words, rows) if r[3] for w in ws}) + 2
        for i, p in enumerate(pairs):
            one = Counter() if not own[i] else Counter(p)
            a1, b1 = Counter(), Counter()
            for (a, b), k in one.items():
                a1[a] += k
                b1[b] += k
            m = n - sum(one.values())
            each = [(big[a, b] - one[a, b] + mass * (uni[b] - b1[b] + 1) / (m + v)) / (ctx[a] - a1[a] + mass) for a, b in p]
            loss[i, side] = sum(-math.log(x) for x in each) / len(each) if each else None
    return words, loss


def test_losses_equal_a_plain_bigram_model(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(EN if i % 3 else DE) for _ in range(rng.randint(0, 12))), i % 3 == 0, True) for i in range(80)] + [(80, None, True, True), (81, "...", False, True), (82, "the winter zebra", True, False), (83, "the unheard of", False, True), (84, "the unheard of", None, True)]
    words, loss = plain_losses([(i, t, bool(g), c) for i, t, g, c in rows])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, good boolean, used boolean, share string, range int").repartition(4)
    for share, keys in ((1_000_000, 400_000), (40, 7)):
        monkeypatch.setattr(lm, "SHARE_TOKENS", share)
        monkeypatch.setattr(lm, "RANGE_KEYS", keys)
        got = lm.score(df, df.good, df.used).collect()
        assert sorted(r.doc_id for r in got) == list(range(85))
        for r in got:
            assert r.n_tokens == len(words[r.doc_id])
            if r.n_tokens:
                assert abs(r.target_loss - loss[r.doc_id, "target"]) < 1e-9 and abs(r.background_loss - loss[r.doc_id, "background"]) < 1e-9
                assert abs(r.score - (r.target_loss - r.background_loss)) < 1e-12
            else:
                assert r.score is None and r.target_loss is None
    german = [r.score for r in got if r.score is not None and r.doc_id % 3 == 0 and r.doc_id < 80]
    english = [r.score for r in got if r.score is not None and r.doc_id % 3 and r.doc_id < 80]
    assert max(german) < min(english)
    assert lm.score(df.limit(0), df.good).count() == 0


def test_repeated_rows_null_ids_and_long_texts(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(None, "a b c", True, True), (None, "a b c", True, True), (7, "a b c", False, True), (7, long, False, True), (8, long + " end", True, True)]
    _, loss = plain_losses(rows)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, good boolean")
    got = sorted((r.n_tokens, r.background_loss, r.target_loss) for r in lm.score(df, df.good).collect())
    want = sorted((len(re.findall(r"\w+", t)), loss[i, "background"], loss[i, "target"]) for i, (_, t, *_) in enumerate(rows))
    assert len(got) == 5 and all(g[0] == w[0] and abs(g[1] - w[1]) < 1e-9 and abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def test_model_grows_with_the_corpus(spark):
    # 30,000 distinct words: each bigram of one document is met once, those of the common pair often
    rows = [(i, " ".join(f"w{i * 60 + j} common pair" for j in range(60)), i % 2 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean").repartition(4)
    n, v = 90_000, 30_002 + 2
    mass = n / (30_002 + 1)  # contexts: all words and the start
    m = n - 180  # without the document itself
    first = -math.log((mass * 1 / (m + v)) / (499 + mass))  # a word after the start
    new = -math.log((mass * 1 / (m + v)) / (29_500 - 59 + mass))  # a word after "pair"
    common = -math.log((mass * (30_001 - 60) / (m + v)) / mass)
    pair = -math.log((30_000 - 60 + mass * (30_001 - 60) / (m + v)) / (30_000 - 60 + mass))
    want = (first + 59 * new + 60 * common + 60 * pair) / 180
    got = lm.score(df, df.good).collect()
    assert len(got) == 500 and all(r.n_tokens == 180 and abs(r.background_loss - want) < 1e-9 for r in got)


# --- language identification ---------------------------------------------------


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(6)
    score, moves = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    length = np.array([4, 2, 1])
    got, expected = langid.forward_backward(score, length, moves)
    want_moves = np.zeros((3, 3))
    for s in range(3):
        n = length[s]
        weight = {p: math.exp(sum(score[s, i, p[i]] for i in range(n)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=int(n))}
        z = sum(weight.values())
        for i in range(n):
            assert np.allclose(got[s, i], [sum(w for p, w in weight.items() if p[i] == k) / z for k in range(3)])
        for p, w in weight.items():
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += w / z
    assert np.allclose(expected, want_moves)


def test_languages_of_held_out_and_mixed_documents(spark):
    rng = random.Random(7)
    make = lambda words, n: " ".join(sentence(rng, words) for _ in range(n))
    rows = [(i, make(EN, 6), "en") if i % 2 else (i, make(DE, 6), "de") for i in range(120)] + [(200, "x", None), (201, None, "en"), (202, "12 %%", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    fresh = [(1, make(EN, 5), "score"), (2, make(DE, 5), "s"), (3, make(EN, 6) + " " + make(DE, 3), "s"), (4, None, None), (5, "", None), (6, "123 ...", None), (1, make(EN, 2), "s")]
    out = {(r.doc_id, i): r for i, r in enumerate(langid.identify(spark.createDataFrame(fresh, "doc_id long, text string, score string"), model).collect())}
    said = [r.lang_pred for r in out.values()]
    assert said == ["en", "de", "en", "und", "und", "und", "en"]
    mixed = [r.score for r in out.values()][2]
    assert 0.55 < mixed < 0.8
    none = langid.train(df.limit(0))
    assert langid.predict(["hello there"], none)[0] == ["und"]
    assert langid.identify(df.limit(0), model).count() == 0
    assert filters.in_a_language(df, model).where("doc_id >= 200").select("doc_id").collect()[0][0] == 200


def test_long_text_is_read_to_its_end():
    rng = random.Random(8)
    texts = [sentence(rng, EN) for _ in range(60)] + [sentence(rng, DE) for _ in range(60)]
    model = langid.fit(texts, ["en"] * 60 + ["de"] * 60)
    text = " ".join(sentence(rng, EN) for _ in range(100)) + " " + " ".join(sentence(rng, DE) for _ in range(3000))
    assert langid.predict([text], model)[0] == ["de"]


# --- quality ---------------------------------------------------------------------


def test_chunks_cover_every_byte():
    for n in (0, 1, quality.STEP, quality.CHUNK, quality.CHUNK + 1, 3 * quality.STEP + 7):
        raw = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        got = quality.chunks(raw)
        back = got[0].tobytes() + b"".join(c[quality.CHUNK - quality.STEP :].tobytes() for c in got[1:])
        assert back[:n] == raw and not any(back[n:]) and len(back) - n <= quality.CHUNK


def quality_corpus(seed, n=300):
    rng = random.Random(seed)
    good = [i % 3 != 0 for i in range(n)]
    texts = [" ".join(sentence(rng, EN) if g else " | ".join(rng.choice(EN) + "%%" for _ in range(9)) for _ in range(rng.randint(1, 30))) for g in good]
    return texts, np.array(good)


def test_quality_on_held_out_documents(spark):
    texts, good = quality_corpus(9)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, None, None), (0, "", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)] + [(None, 1), (2, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    fresh, marks = quality_corpus(10)
    said = quality.predict(fresh, model) >= 0.3
    assert said[marks].mean() > 0.95 and said[~marks].mean() < 0.1
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(texts) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0
    one = quality.train(docs, labels.where("quality = 1"))
    assert quality.predict(["a"], one).tolist() == [1.0]
    assert quality.predict(["a"], quality.train(docs.limit(0), labels.limit(0))).tolist() == [1.0]


def test_a_bad_part_anywhere_counts():
    texts, good = quality_corpus(11)
    model = quality.fit(texts, good, good.mean())
    rng = random.Random(12)
    fine = " ".join(sentence(rng, EN) for _ in range(200))
    junk = " ".join(" | ".join(rng.choice(EN) + "%%" for _ in range(9)) for _ in range(200))
    scores = quality.predict([fine, fine + junk, junk + fine], model)
    assert scores[0] > max(scores[1:])


# --- training samples ------------------------------------------------------------


def test_long_texts_stay_in_the_sample(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(sentence(rng, EN if i % 2 else DE) for _ in range(600)), "en" if i % 2 else "de") for i in range(24)]
    assert min(len(t) for _, t, _ in rows) > 20_000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = sampling.fetch(df, df.select("doc_id"), "doc_id", ["text", "lang"], 20_000)
    assert some["doc_id"].tolist() == list(range(24))
    for i, text in zip(some["doc_id"], some["text"], strict=True):
        whole, parts = rows[i][1], text.split("\n")
        assert [len(p) for p in parts] == [1000] * 20
        step = len(whole) // 20
        assert all(p in whole[k * step : (k + 1) * step] for k, p in enumerate(parts))
    model = langid.train(df)
    assert langid.predict(["the winter lake and the shore", "der winter und das schiff nicht weiter"], model)[0] == ["en", "de"]
    bad, marks = toxic_corpus(5, 120)
    docs = spark.createDataFrame([(i, " ".join([t] * (1 + 24_000 // len(t)))) for i, t in enumerate(bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(m), int(not m)) for i, m in enumerate(marks)], "doc_id long, toxic int, quality int")
    assert len(toxicity.train(docs, labels).keys)
    assert quality.train(docs, labels).constant is None


def test_every_language_is_learned(spark):
    # 201 languages, each of its own five words in three documents; the last one is the rarest
    own = [[f"{chr(0x4E00 + 7 * k)}{chr(0x4E01 + 7 * k + j)}" for j in range(5)] for k in range(201)]
    rows = [(4 * k + c, " ".join(own[k] * 2) + ".", f"l{k:03}") for k in range(201) for c in range(3 if k < 200 else 2)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 201
    assert langid.predict([" ".join(own[200])], model)[0] == ["l200"]


def test_language_samples_take_the_least_hashes(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'Der See.', 'The lake.') AS text", "if(id % 3 = 0, 'de', 'en') AS lang")
    held = {}
    fetch = sampling.fetch
    try:
        sampling.fetch = lambda docs, ids, *rest: held.setdefault("ids", {r.doc_id for r in ids.collect()}) and fetch(docs, ids, *rest)
        langid.train(df)
    finally:
        sampling.fetch = fetch
    want = {r.doc_id for n in ("de", "en") for r in sampling.by_hash(df.where(df.lang == n), "doc_id", langid.LANGUAGE_DOCS, 4).collect()}
    assert held["ids"] == want and len(want) == 500
