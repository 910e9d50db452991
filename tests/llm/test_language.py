"""Language identification: counts and scores against plain Python, held-out accuracy, awkward cases."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dialframe.llm import language_nb, queries
from tests.conftest import SF_CHECK
from tests.llm import fixtures


def grams(text):
    s = f" {text.lower()}  "
    return [s[i:i + n] for i in range(len(text.lower()) + 1) for n in (1, 2, 3)]


def bucket(gram, buckets):
    h, m = 0, 1 << 32
    for k, c in enumerate(gram):
        h = (h ^ ord(c)) * language_nb._MULTIPLIERS[k] % m
        h ^= h >> 15
    return (h * language_nb._MULTIPLIERS[0] % m) >> (32 - buckets.bit_length() + 1)


def brute(rows, buckets=language_nb.BUCKETS, a=language_nb.SMOOTHING):
    """(doc_id, held_out, lang_pred, score) by dictionaries."""
    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    train = [(t or "", lang) for i, t, lang in rows if lang is not None and not out(i)]
    docs, counts = Counter(lang for _, lang in train), {}
    for t, lang in train:
        counts.setdefault(lang, Counter()).update(bucket(g, buckets) for g in grams(t))
    result = []
    for i, t, _ in rows:
        if t is None or not docs or not any(c.isalpha() for c in t):
            result.append((i, out(i), "und", 0.0))
            continue
        found = Counter(bucket(g, buckets) for g in grams(t))
        joint = {}
        for lang in sorted(docs):
            total = sum(counts[lang].values()) + a * buckets
            joint[lang] = math.log(docs[lang] / len(train)) + sum(
                n * math.log((counts[lang][b] + a) / total) for b, n in found.items())
        best = max(sorted(joint), key=joint.get)
        result.append((i, out(i), best, 1 / sum(math.exp(v - joint[best]) for v in joint.values())))
    return result


def same(got, want):
    key = lambda r: (repr(r[0]), r[1], r[2], r[3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-6)


def rows():
    names = ["aa", "bb", "cc"]
    out = [(i, t, None if i is None or i % 9 == 0 else names[i % 3]) for i, t in fixtures.texts()]
    return out + [(5000, "12 34 !", "aa"), (5001, "ⅷ ² 5", "bb"), (5002, "\U0001F600", "bb"), (5003, "İSTANBUL ß", "cc"),
                  (5004, "中", "aa")]


def frame(spark, data):
    return spark.createDataFrame([(i, t, lang, "s", 1, *fixtures.CLASH) for i, t, lang in data], fixtures.SCHEMA)


def test_predictions_equal_brute_force(spark):
    data = rows()
    df = language_nb.identify(frame(spark, data).repartition(5))
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"]
    same(df.collect(), brute(data))


def test_a_long_text_is_scored_in_pieces(monkeypatch):
    texts = ["x" * 10, " ".join(fixtures.words(1, 500)), "", "é", " ".join(fixtures.words(2, 90))]
    r = np.random.default_rng(1)
    model = language_nb.Model(["a", "b"], np.log(r.random((1 << 10, 2))), np.log([0.5, 0.5]))
    want = language_nb.log_scores(texts, model)
    for piece in (1, 2, 3, 7, 100):
        monkeypatch.setattr(language_nb, "PIECE", piece)
        assert np.allclose(language_nb.log_scores(texts, model), want)
    alone = [language_nb.log_scores([t], model)[0] for t in texts]
    assert np.allclose(alone, want)


def test_without_training_rows_or_any_rows(spark):
    assert language_nb.identify(frame(spark, [])).collect() == []
    got = language_nb.identify(frame(spark, [(1, "some text", None), (2, None, None)])).collect()
    assert [tuple(r)[2:] for r in got] == [("und", 0.0)] * 2


def test_many_languages_shrink_the_matrix(spark):
    data = [(i, f"text {i} " + chr(97 + i % 26) * 5, f"l{i}") for i in range(300)]
    model = language_nb.train(frame(spark, data))
    assert len(model.languages) == 300 and model.log_probability.size <= language_nb.CELLS
    assert model.buckets == 1 << 13


def test_a_prediction_sees_the_text_only(spark):
    data = [(i, t, lang) for i, t, lang in rows() if i is not None]
    model = language_nb.train(frame(spark, data))
    one = {r[0]: tuple(r) for r in language_nb.predict(frame(spark, data), model).collect()}
    blind = {r[0]: tuple(r) for r in language_nb.predict(frame(spark, [(i, t, "zz") for i, t, _ in data]), model).collect()}
    assert one == blind


def test_held_out_accuracy(spark):
    got = queries.op13_language_nb(spark, SF_CHECK)
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang")
    kept = got.join(docs, "doc_id").where("held_out and lang is not null")
    right, n = kept.select(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 200 and right >= 0.98 * n
    assert got.count() == docs.count()
