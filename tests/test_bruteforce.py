"""Operators against small pure-Python implementations of the same rules, on many random cases.

Every case is one key of a single DataFrame, so one Spark job checks hundreds of cases.
"""

import math
import random
from collections import Counter


from dialframe.operators.stats import histogram, token_counts, top_tokens
from dialframe.operators.turns import merge_examples, merge_turns
from dialframe.operators.vote import hard_vote


def py_merge(rows, refs):
    """rows: [(speaker, text, id)] already without empty texts."""
    out = []
    for spk, txt, uid in rows:
        if out and out[-1][0] == spk and uid not in refs and out[-1][2][-1] not in refs:
            out[-1] = (spk, out[-1][1] + " " + txt, out[-1][2] + [uid])
        else:
            out.append((spk, txt, [uid]))
    return [(s, t.strip(), ids) for s, t, ids in out if t.strip()]


def _random_cases(seed, n_cases=150):
    rnd = random.Random(seed)
    cases = []
    for k in range(n_cases):
        n = rnd.randint(1, 40)
        rows = [(rnd.choice([1, 2]) if rnd.random() < 0.5 else (cases and 1 or 2), rnd.choice(["a", "b", "c d", "é"]),
                 f"{k}.{i}") for i in range(n)]
        refs = [r[2] for r in rows if rnd.random() < 0.15]
        cases.append((rows, refs))
    return cases


def test_merge_long_and_nested_vs_python(spark):
    cases = _random_cases(11)
    long_rows = [(k, i, s, t, u, u in refs) for k, (rows, refs) in enumerate(cases) for i, (s, t, u) in enumerate(rows)]
    df = spark.createDataFrame(long_rows, "k int, pos int, speaker int, text string, utterance_id string, is_ref boolean")
    want = {k: py_merge(rows, set(refs)) for k, (rows, refs) in enumerate(cases)}
    for chunk in (None, 5):
        got = {}
        for r in merge_turns(df, "k", "pos", chunk=chunk, hot_rows=3).orderBy("k", "pos").collect():
            got.setdefault(r["k"], []).append((r["speaker"], r["text"], list(r["utterance_ids"])))
        assert got == want
    nested = spark.createDataFrame(
        [(k, [{"speaker": s, "utterance": t, "utterance_id": u} for s, t, u in rows], refs)
         for k, (rows, refs) in enumerate(cases)],
        "k int, conversation array<struct<speaker:int,utterance:string,utterance_id:string>>, refs array<string>")
    merged = merge_examples(nested.withColumnRenamed("refs", "reference_id"), ids_are_arrays=False)
    got = {r["k"]: [(u["speaker"], u["utterance"], list(u["utterance_id"])) for u in r["conversation"]]
           for r in merged.collect()}
    assert got == want


def py_hist(values, step):
    top = max(values)
    nb = max(math.ceil(top / step), 1)
    counts = [0] * nb
    for v in values:
        counts[min(v // step, nb - 1)] += 1
    return counts


def test_histogram_vs_python(spark):
    rnd = random.Random(5)
    groups = {f"g{i}": [rnd.randint(0, rnd.choice([3, 60, 1200])) for _ in range(rnd.randint(1, 60))] for i in range(80)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v long")
    for step in (1, 50):
        got = {}
        for r in histogram(df, "v", step, "g").orderBy("g", "bin").collect():
            got.setdefault(r["g"], []).append(r["n"])
        assert got == {g: py_hist(vs, step) for g, vs in groups.items()}


def py_tokens(texts):
    import re
    c = Counter()
    for t in set(texts):
        for tok in t.split(" "):
            for ch in "ㅋㅎㅇㄱㄴㄷ":
                tok = re.sub(ch + "+", ch * 2, tok)
            if len(tok) > 1:
                c[tok] += 1
    return c


def test_tokens_and_top_k_vs_python(spark):
    rnd = random.Random(3)
    alphabet = ["ㅋ", "ㅎ", "ㅇ", "a", "b", "가", " ", " ", "ㄷ", "é"]
    texts = {f"s{i}": ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
             for i in range(6)}
    df = spark.createDataFrame([(s, t) for s, ts in texts.items() for t in ts + ts[:5]], "split string, text string")
    counts = token_counts(df, "text", "split")
    got = {}
    for r in counts.collect():
        got.setdefault(r["split"], Counter())[r["token"]] = r["n"]
    want = {s: py_tokens(ts) for s, ts in texts.items()}
    assert got == {s: c for s, c in want.items() if c}
    top = {}
    for r in top_tokens(counts, 7, "split").orderBy("split", "rank").collect():
        top.setdefault(r["split"], []).append(r["token"])
    for s, c in want.items():
        assert top.get(s, []) == [t for t, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:7]]


def test_votes_vs_python(spark):
    rnd = random.Random(9)
    cases = {f"q{i}": [rnd.choice(["inference_1", "inference_2", "inference_3"]) for _ in range(rnd.randint(1, 11))]
             for i in range(300)}
    df = spark.createDataFrame([(q, o, r) for q, vs in cases.items() for r, o in enumerate(vs, start=1)],
                               "id string, output string, rank int")
    got = {r["id"]: r["output"] for r in hard_vote(df).collect()}
    assert got == {q: max(vs, key=vs.count) for q, vs in cases.items()}


def test_staged_nested_merge_vs_python(spark):
    from dialframe.operators.turns import merge_examples
    cases = _random_cases(23, n_cases=120)
    nested = spark.createDataFrame(
        [(k, [{"speaker": s, "utterance": t, "utterance_id": [u]} for s, t, u in rows], refs)
         for k, (rows, refs) in enumerate(cases)],
        "k int, conversation array<struct<speaker:int,utterance:string,utterance_id:array<string>>>, "
        "reference_id array<string>")
    got = {r["k"]: [(u["speaker"], u["utterance"], list(u["utterance_id"])) for u in r["conversation"]]
           for r in merge_examples(nested).collect()}
    assert got == {k: py_merge(rows, set(refs)) for k, (rows, refs) in enumerate(cases)}
    plan = merge_examples(nested)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(sequence(") == 1     # the run starts are computed once
