"""The corpus pipeline: each stage on what its predecessor kept, against brute force, and its edge cases."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from dialframe.llm import secret_crf
from tests.conftest import SF_SMALL
from tests.llm import fixtures
from tests.llm.test_documents import brute_base, brute_hits, brute_near


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's output on the small tables, written and read again as the pipeline does."""
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_schemas(steps):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert steps[name].schema.simpleString() == steps["input"].schema.simpleString(), name


def test_quality_drops_junk_and_keeps_clean(spark, steps):
    kept = dict(texts(steps["quality"]))
    labels = dict(spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "quality").collect())
    wrong = 0
    for doc, text in texts(steps["input"]):
        base = brute_base(text)
        if base[0] < 20 or 100 * base[4] > 30 * base[0]:
            assert doc not in kept
        elif doc in labels:
            wrong += (doc in kept) != (labels[doc] == 1)
    assert wrong <= 2


def test_near_dedup_keeps_one_of_each_group(steps):
    want = {row[0] for row in brute_near(texts(steps["quality"]), 80) if row[3]}
    assert {d for d, _ in texts(steps["near_dedup"])} == want
    assert set(texts(steps["near_dedup"])) <= set(texts(steps["quality"]))


def test_decontamination_drops_exactly_the_hit_ones(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits(texts(steps["near_dedup"]), items)
    want = {row[0] for row in hits if row[2] == 0}
    assert {d for d, _ in texts(steps["decontaminate"])} == want
    assert len(want) < len(hits)


def test_secrets_are_masked_and_nothing_else(steps):
    before, after = dict(texts(steps["decontaminate"])), dict(texts(steps["secrets"]))
    assert set(before) == set(after)
    for doc, text in before.items():
        assert not secret_crf.base_spans(after[doc])
        parts = [re.escape(x) for x in after[doc].split("[SECRET]")]
        assert re.fullmatch("(?s:.*?)".join(parts), text)
        if not secret_crf.base_spans(text):
            assert after[doc] == text
    assert {r.n_chars == len(r.text) for r in steps["secrets"].collect()} == {True}


def test_packing_holds_all_that_is_left(steps):
    rows = steps["pack"].collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert set(got) == {d for d, _ in texts(steps["secrets"])}
    assert all(got[r.doc_id] == r.doc_tokens for r in rows)


def test_run_equals_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, steps["pack"].collect()))


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls, repeats and clashing columns: a defined result, no crash."""
    odd = [r for r in fixtures.texts()]
    docs = fixtures.documents(spark, odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = [r.doc_id for r in docs.collect()]
    assert None in left and left.count(413) <= 1 and not {400, 401, 402, 403} & set(left)
    assert sum(200 <= (i or 0) < 225 for i in left) < 10


def test_empty_documents(spark, tmp_path):
    docs = fixtures.documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_near_dedup_links_pairs_from_080(spark):
    """Pairs from 0.80 up to 0.85 are linked and one row of each stays; pairs just under 0.80 stay whole."""
    rows, similar = [], {}
    for k in range(24):
        head, tail = fixtures.words(3000 + k, 124, 4000), fixtures.words(4000 + k, 30, 4000)
        # Of 120 shingles each the pair shares 120 - m, that is (120 - m) / (120 + m).
        m = (10, 12, 13, 14)[k % 4]
        rows += [(1000 + 2 * k, " ".join(head)), (1001 + 2 * k, " ".join(head[m:] + tail[:m]))]
        similar[1001 + 2 * k] = (120 - m) / (120 + m)
    assert {round(s, 3) for s in similar.values()} == {0.846, 0.818, 0.805, 0.791}
    left = {i for i, _ in texts(corpus_pipeline.near_dedup(spark, fixtures.documents(spark, rows), SF_SMALL))}
    assert left == {i for i, _ in rows if similar.get(i, 0) < 0.8}
    assert left == {row[0] for row in brute_near(rows, 80) if row[3]}


def test_near_dedup_of_the_corpus_is_the_brute_force_at_080(steps):
    want = {row[0] for row in brute_near(texts(steps["quality"]), 80) if row[3]}
    assert {d for d, _ in texts(steps["near_dedup"])} == want


def test_a_task_gives_back_memory_after_its_last_batch(monkeypatch):
    """Workers wait between tasks; what a task has freed must not stay with them."""
    from dialframe.llm import common
    seen = []

    class Frame:
        sparkSession = None

        def mapInArrow(self, fn, schema):
            return fn(iter([1, 2]))

    monkeypatch.setattr(common, "ship_package", lambda spark: None)
    monkeypatch.setattr(common, "give_back_memory", lambda: seen.append("back"))
    seen += [0]
    for x in common.map_batches(Frame(), lambda batches: (x + 1 for x in batches), "x long"):
        seen.append(x)
    assert seen == [0, 2, 3, "back"]
