"""Vector codes and hard negatives against plain Python, and their awkward cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialframe.llm import code_compression, hard_negatives, queries
from tests.conftest import SF_CHECK
from tests.parity import compare, duck

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, rank string, planes string, v string"
CLASH = ("x",) * 5


def vectors(n=330, width=12, seed=1):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(0, 0.2), 3) for _ in range(width)], r.choice([0, 1, 2, None])) for i in range(n)]
    common = [0.25] * width
    rows += [(1000 + i, common, i % 2) for i in range(60)]  # one vector in many rows: ties
    rows += [(2000, None, 1), (2001, [None] + [0.1] * (width - 1), 1), (2002, [math.nan] * width, 0),
             (2003, [math.inf] * width, 0), (2004, [], 1), (2005, [0.5, -0.5], 2), (2050, common, 1), (None, common, 1)]
    rows += [rows[7], rows[7], (2100, common, None)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def whole(rows, scale):
    """(vec_id, label, integers as float32 gives them) of the usable rows, zeros at the end."""
    out = [(i, label, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, label in rows
           if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in out), default=0)
    return [(i, label, v + [0] * (width - len(v))) for i, label, v in out]


def brute_codes(rows, parts=4, entries=256, rounds=4):
    data = sorted(whole(rows, 1024), key=lambda r: (r[0] is None, r[0], r[2]))
    if not data:
        return [], []
    width = -(-len(data[0][2]) // parts)
    cut = [[(v + [0] * (width * parts))[p * width:(p + 1) * width] for p in range(parts)] for _, _, v in data]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found = [nearest(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(col) // len(col) for col in zip(*[c[p] for c, f in zip(cut, found) if f == e])]
                        if e in found else old for e, old in enumerate(books[p])]
    out = []
    for (i, label, _), c in zip(data, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{b[1]:02x}" for b in best), sum(b[0] for b in best)))
    per_label = {k: sum(r[3] for r in out if r[1] == k) for k in {r[1] for r in out}}
    return sorted(((i, label, code, error, per_label[label]) for i, label, code, error in out), key=repr), books


@pytest.mark.parametrize("entries", [256, 16])
def test_codes_equal_brute_force(spark, entries):
    rows = vectors()
    got, books = code_compression.compress(frame(spark, rows), entries=entries)
    want, want_books = brute_codes(rows, entries=entries)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert books.tolist() == want_books


def test_codes_of_few_rows_and_of_none(spark):
    rows = vectors()[:5] + [(7000, [0.1] * 7, 3)]
    got, books = code_compression.compress(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows)[0]
    got, books = code_compression.compress(frame(spark, []))
    assert got.collect() == [] and books.size == 0
    got, _ = code_compression.compress(frame(spark, [(1, None, 1), (2, [math.nan], 1)]))
    assert got.collect() == []


def test_nearest_is_exact_with_ties_and_stops_early():
    r = np.random.default_rng(3)
    for spread, offset in ((5, 0), (3000, 0), (1 << 24, 0), (4, 100)):
        book = r.integers(-spread, spread + 1, (200, 6))
        book[150:] = book[:50]  # equal entries: the lower index wins
        book += offset * (np.arange(200)[:, None] % 50)
        rows = np.concatenate([r.integers(-spread, spread + 1, (900, 6)), book[100:160]])
        seen = []
        index, dist = code_compression.nearest(rows, book, seen)
        d = ((rows[:, None, :] - book[None]) ** 2).sum(-1)
        assert (dist == d.min(1)).all() and (index == d.argmin(1)).all()
        if offset:
            assert sum(seen) < 0.6 * d.size


def brute_negatives(rows, anchors, k=5, n=3):
    data = {}
    for i, label, v in whole(rows, 256):
        if i is not None and label is not None:
            data[i] = min(data.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in data.items():
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lb) for i, (lb, w) in data.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2] == label][:k]:
            hard = [s for s in scored if s[2] != label and -50 * ps <= -100 * s[0] <= -95 * ps][:n]
            out += [(a, p, rank, i, -ps, -s) for rank, (s, i, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(512, 8192), (7, 50)])
def test_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", blocks[1])
    rows = vectors()
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 100 and {r[0] for r in want} & {2050}


def test_negatives_without_anchors_or_rows(spark):
    assert hard_negatives.mine(frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    rows = [(1, [0.1], 1), (2, [0.2], 2)]
    assert hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(frame(spark, [(10, [], 1), (11, [], 1), (12, [], 0)]), F.col("vec_id") == 10).collect() == [
        (10, 11, 1, 12, 0, 0)]


def test_lookups_are_exact_inner_products():
    r = np.random.default_rng(4)
    for most in (1, 300, 1 << 24):
        rows, anchors = r.integers(-most, most, (90, 21)), r.integers(-most, most, (11, 21))
        bits = 1 + int(most).bit_length()
        planes = hard_negatives.bit_planes(rows, bits).transpose(1, 2, 0)
        assert (hard_negatives.lookup_scores(planes, hard_negatives.subset_sums(anchors)) == anchors @ rows.T).all()


@pytest.mark.parametrize("name", ["op11_code_compression", "op12_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    res = compare(spark, duck(SF_CHECK), name, SF_CHECK)
    assert res.get("match") and "type_mismatch" not in res, res


def test_plan_has_no_cross_join(spark):
    df = queries.op12_hard_negatives(spark, SF_CHECK)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
