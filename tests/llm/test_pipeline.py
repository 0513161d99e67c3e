"""Each stage against a plain version on its own input."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from leadlake.llm import pretoken, toxicity
from leadlake.llm.queries import tokenizer_path
from leadlake.llm.store import written

from .test_neardup import plain_classes
from .test_topk_mixing import poisson

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        made = written(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, made))
        docs = made
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_all_but_the_last_keep_the_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_stage(spark, steps):
    before, after = steps[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    some = {i: r.text for i, r in sorted(by_id(before).items()) if labels.get(i) is not None and zlib.crc32(str(i).encode()) % 5}
    model = toxicity.fit(list(some.values()), np.array([labels[i] == 1 for i in some]))
    rows = by_id(before)
    score = dict(zip(rows, toxicity.document_scores([r.text for r in rows.values()], model)[0]))
    assert set(by_id(after)) == {i for i, s in score.items() if s < 0.5}


def test_language_stage(steps):
    before, after = steps[1]
    kept, rows = by_id(after), by_id(before)
    assert set(kept) <= set(rows)
    assert all(any(c.isalpha() for c in r.text) for r in kept.values())
    assert len(kept) > 0.9 * len(rows)


def test_dedup_stage(steps):
    before, after = steps[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(by_id(after)) == sorted({c for _, c in plain_classes(rows)})


def test_mixing_stage(steps):
    import hashlib

    before, after = steps[3]
    rows = before.collect()
    counts = Counter(r.source for r in rows)
    want = Counter()
    for r in rows:
        u = (int(hashlib.md5(f"{r.doc_id}:1:0".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        want[r.doc_id] = poisson(u, len(rows) / len(counts) / counts[r.source])
    assert Counter(r.doc_id for r in after.collect()) == +want


def test_packing_stage(steps):
    before, after = steps[4]
    whole = pretoken.tokenizer(tokenizer_path())
    want = Counter()
    for r in before.collect():
        want[r.doc_id] += len(whole.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
    assert got == want


HARD = "doc_id long, text string, lang string, source string, n_chars long, content string, task int, mix_key string, share long, deal long"


def test_stages_on_hard_rows(spark):
    long = " ".join(f"word{i % 211}" for i in range(60_000))
    plain = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(6).collect()]
    rows = [(1, plain[0]), (1, plain[0]), (None, plain[1]), (2, None), (3, ""), (4, " \n"), (5, "123 %%"), (6, long), (7, plain[2]), (8, plain[2]), (None, None)]
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s", None, "c", 1, "m", 2, 3) for k, (i, t) in enumerate(rows)], HARD)
    text = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    safe = cp.drop_toxic(spark, docs, SF)
    assert safe.columns == docs.columns and text(safe) == Counter(rows)
    one = cp.drop_near_duplicates(spark, docs, SF)
    assert one.columns == docs.columns
    assert text(one) == Counter([(1, plain[0]), (None, plain[1]), (2, None), (3, ""), (4, " \n"), (5, "123 %%"), (6, long), (7, plain[2]), (None, None)])
    known = cp.drop_unknown_language(spark, docs, SF)
    assert known.columns == docs.columns and not {t for _, t in text(known)} & {None, "", " \n", "123 %%"}
    mixed = cp.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and set(text(mixed)) <= set(rows)
    packed = cp.pack_sequences(spark, docs, SF).collect()
    whole = pretoken.tokenizer(tokenizer_path())
    assert sum(r.length for r in packed) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.start == 0 for r in packed) == len(rows)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], HARD)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_run_applies_all_stages(spark, steps):
    assert cp.run(spark, SF).count() == steps[-1][1].count()


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_begin_by_giving_back_memory_of_the_driver(spark, monkeypatch, name, stage):
    class GivenBack(Exception):
        pass

    def release(session=None):
        assert session is spark
        raise GivenBack

    monkeypatch.setattr(cp, "release", release)
    with pytest.raises(GivenBack):
        stage(spark, None, None)


def test_giving_back_memory_shrinks_the_heap_of_the_jvm(spark):
    from leadlake.llm.sampling import release

    count = lambda: sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName())
    before = count()
    release(spark)
    assert count() > before
