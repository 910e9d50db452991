"""Document operators against brute force on the awkward fixture, and on the driver tables' oracles."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from dialframe.llm import (components, decontaminate, hilbert_pack, induced_sort, minhash_dedup, quality_lr,
                           secret_crf, suffix_dedup)
from dialframe.llm.queries import tokenizer_path
from tests.conftest import SF_CHECK
from tests.llm import fixtures
from tests.parity import compare, duck


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.documents(spark).cache()


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# ---- op1: substring dedup

def brute_dedup(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[k:k + length] for _, d in data for k in range(len(d) - length + 1))
    out = Counter()
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if count[d[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out[(i, len(d), len(d) - len(kept), len(re.findall(b"\1+", bytes(gone))),
             hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length", [200, 64])
def test_substring_dedup_equals_brute_force(docs, length):
    got = suffix_dedup.digest(suffix_dedup.dedup_substrings(docs, length))
    assert rows_of(got, *got.columns) == brute_dedup(fixtures.texts(), length)


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_induced_sort_marks_equal_brute_force(monkeypatch, block):
    """With a block of 7 every array, queue and sort goes through disk."""
    import random
    monkeypatch.setattr(induced_sort, "BLOCK", block)
    monkeypatch.setattr(induced_sort, "QUEUE_ENTRIES", 1 << 21 if block > 7 else 11)
    r = random.Random(4)
    for _ in range(60):
        length, letters = r.choice([1, 2, 3, 5, 8, 9, 17]), r.choice([b"ab", b"abc", b"\x00\xfe", b"abcdefgh"])
        segments = [bytes(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 7))]
        segments += [segments[0][3:] + b"x", b"a" * r.randint(0, 50)]
        count = Counter(s[i:i + length] for s in segments for i in range(len(s) - length + 1))
        for s, marks in zip(segments, induced_sort.repeated(segments, length)):
            assert marks.tolist() == [count[s[i:i + length]] > 1 for i in range(len(s) - length + 1)]


def test_shards_do_not_change_the_result(docs, monkeypatch):
    one = rows_of(suffix_dedup.digest(suffix_dedup.dedup_substrings(docs)), "doc_id", "kept_sha256")
    for name, value in (("_STRETCH", 333),):
        monkeypatch.setattr(suffix_dedup, name, value)
    text = fixtures.texts()[0][1].encode() * 3
    whole = {w: a for a, s, n in suffix_dedup.segments(text) for w in range(s, s + n)}
    monkeypatch.undo()
    assert whole == {w: a for a, s, n in suffix_dedup.segments(text) for w in range(s, s + n)}
    assert sum(one.values()) == len(fixtures.texts())


# ---- op2: near duplicates

def test_a_hot_anchor_is_not_dealt_to_one_task(spark, monkeypatch):
    """The edges of a common passage have a distinct segment per document; no shard gets all of them."""
    passage = " ".join(fixtures.words(5, 80))
    rows = [(k, " ".join(fixtures.words(7000 + k, 40)) + " " + passage[k % 3:] + " " + " ".join(fixtures.words(8000 + k, 40)))
            for k in range(60)]
    docs, sorted_ = fixtures.documents(spark, rows), []
    map_batches = suffix_dedup.map_batches

    def watched(df, fn, schema):
        if "bytes" in df.columns:
            sorted_.append(df)
        return map_batches(df, fn, schema)

    monkeypatch.setattr(suffix_dedup, "map_batches", watched)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BYTES", 4000, raising=False)
    got = suffix_dedup.digest(suffix_dedup.dedup_substrings(docs))
    sizes = [r["sum(size)"] for df in sorted_ for r in
             df.selectExpr("anchor", "length(bytes) AS size").groupBy("anchor").sum("size").collect()]
    assert max(sizes, default=0) <= 4000
    assert rows_of(got, *got.columns) == brute_dedup(rows, 200)
    for most in (0, 1 << 40):  # all anchors by windows; none
        monkeypatch.setattr(suffix_dedup, "ANCHOR_BYTES", most)
        odd = suffix_dedup.digest(suffix_dedup.dedup_substrings(fixtures.documents(spark)))
        assert rows_of(odd, *odd.columns) == brute_dedup(fixtures.texts(), 200)


def brute_near(rows, percent=85):
    sets = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        w = [x for x in re.split("[\x20\x09-\x0D]+", (t or "").translate(
            {c: c + 32 for c in range(65, 91)})) if x]
        n = min(5, len(w))
        sets[k] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if w else set()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            same_id = rows[x][0] is not None and rows[x][0] == rows[y][0]
            if None in (rows[x][0], rows[y][0]):
                continue
            if same_id or a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    least = defaultdict(lambda: math.inf)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least[find(k)], i)
    return Counter((i, len(sets[k]), None if i is None else least[find(k)], i is None or least[find(k)] == i)
                   for k, (i, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(docs):
    got = minhash_dedup.near_duplicates(docs)
    assert rows_of(got, *got.columns) == brute_near(fixtures.texts())


def test_stars_split_over_tasks_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "STAR_ROWS", 3)
    got = minhash_dedup.near_duplicates(docs)
    assert rows_of(got, *got.columns) == brute_near(fixtures.texts())


def test_drifting_chain_needs_the_second_round(spark):
    """Links between nodes that no star centre links: components of round 1 are joined in round 2."""
    rows, words = [], fixtures.words(11, 200, 5000)
    for k in range(40):
        rows.append((1000 - k if k % 2 else k, " ".join(words)))
        for j in range(3):
            words[(k * 13 + j) % 200] = f"k{k}j{j}"
    docs = fixtures.documents(spark, rows)
    got = minhash_dedup.near_duplicates(docs)
    assert rows_of(got, *got.columns) == brute_near(rows)


def test_one_id_with_two_texts_links_both(spark):
    """Each text of an id is verified; what either is near to belongs to the id's component."""
    a, b = (" ".join(fixtures.words(k, 200, 3000)) for k in (81, 82))
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (8, b + " more"), (9, b), (4, " ".join(fixtures.words(83, 90)))]
    got = minhash_dedup.near_duplicates(fixtures.documents(spark, rows))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(4, 4), (5, 5), (6, 5), (7, 5), (8, 5), (9, 5)}
    low = [(5, a), (5, b), (3, b + " more"), (6, a + " more")]
    got = minhash_dedup.near_duplicates(fixtures.documents(spark, low))
    assert {(r.doc_id, r.component_id, r.kept) for r in got.collect()} == {(5, 3, False), (3, 3, True), (6, 3, False)}


def test_pairs_after_the_star_rounds_find_all_links(docs, monkeypatch):
    """One round links little; the remaining pairs, each in its first shared band, give the rest."""
    monkeypatch.setattr(minhash_dedup, "STAR_ROUNDS", 1)
    got = minhash_dedup.near_duplicates(docs)
    assert rows_of(got, *got.columns) == brute_near(fixtures.texts())


def test_a_large_group_of_near_copies_is_not_linked_by_all_its_pairs(spark, monkeypatch):
    """Copies of one base, few of them near to all others: rounds of central nodes leave few pairs."""
    base, rows = fixtures.words(21, 200, 5000), []
    for k in range(150):
        words = list(base)
        for j in range(1 if k % 8 == 0 else 2):
            words[(k * 37 + j * 83) % 190 + 5] = f"k{k}j{j}"
        rows.append((k, " ".join(words)))
    verified, verify = [], minhash_dedup.verify

    def counted(pairs, *args):
        verified.append(pairs.count())
        return verify(pairs, *args)

    monkeypatch.setattr(minhash_dedup, "verify", counted)
    got = minhash_dedup.near_duplicates(fixtures.documents(spark, rows))
    assert rows_of(got, *got.columns) == brute_near(rows)
    assert verified[-1] <= len(rows), verified  # the pairs after the rounds


def test_without_rounds_the_pairs_find_all_links(docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TOKEN_ROUNDS", ())
    got = minhash_dedup.near_duplicates(docs)
    assert rows_of(got, *got.columns) == brute_near(fixtures.texts())


def test_superminhash_is_the_sequential_algorithm():
    """Signatures with early stop equal those of the element-by-element definition."""
    places = 16
    sets = [minhash_dedup.shingle_set(" ".join(fixtures.words(k, n))) for k, n in enumerate((1, 6, 9, 40, 200))]
    got = minhash_dedup.signatures(sets, places)
    for s, row in zip(sets, got):
        best = [None] * places
        for e in s:
            order = list(range(places))
            for rank in range(places):
                r = int(minhash_dedup._mix(np.array([(int(e) + (rank + 1) * 0x9E3779B97F4A7C15) % (1 << 64)],
                                                    np.uint64))[0])
                k = rank + (((r >> 32) * (places - rank)) >> 32)
                order[rank], order[k] = order[k], order[rank]
                value = (rank << 32) | (r & 0xFFFFFFFF)
                p = order[rank]
                best[p] = value if best[p] is None else min(best[p], value)
        assert row.tolist() == best


def test_signature_estimates_similarity():
    a = np.arange(1, 2001, dtype=np.uint64)
    b = np.arange(301, 2301, dtype=np.uint64)
    x, y = minhash_dedup.signatures([minhash_dedup._mix(a), minhash_dedup._mix(b)], 1024)
    assert abs((x == y).mean() - 1700 / 2300) < 0.05


def test_sketch_bound_keeps_pairs_at_the_threshold(spark):
    """Mismatches of two-bit sketches, as SQL counts them, stay under the bound for similar pairs only."""
    bound, rows = minhash_dedup.most_mismatches(85), []
    for k in range(60):
        a = np.arange(1 + 5000 * k, 601 + 5000 * k, dtype=np.uint64)
        for shift in (0, 48, 400):  # similarity 1, 0.852 and 0.2
            best = minhash_dedup.signatures([minhash_dedup._mix(a), minhash_dedup._mix(a + np.uint64(shift))])
            x, y = minhash_dedup.two_bits(best)
            want = sum((int(p) >> 2 * i & 3) != (int(q) >> 2 * i & 3) for p, q in zip(x, y) for i in range(32))
            rows.append((shift, x.tolist(), y.tolist(), want))
    df = spark.createDataFrame(rows, "shift int, x array<long>, y array<long>, want int")
    got = df.selectExpr("shift", "want", f"{minhash_dedup._mismatches('x', 'y')} AS n").collect()
    assert all(r.n == r.want for r in got)
    assert all(r.n <= bound for r in got if r["shift"] < 400) and all(r.n > bound for r in got if r["shift"] == 400)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 300), (300, 200), (200, 100), (7, 7), (None, 5), (500, 499)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100, 500: 499, 499: 499}


# ---- op5: decontamination

def brute_hits(rows, items, window=10):
    cut = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}

    def w(t):
        return cut.findall((t or "").translate(low))

    windows = defaultdict(set)
    for item, text in items:
        x = w(text)
        n = min(window, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            windows[tuple(x[i:i + n])].add(item)
    out = Counter()
    for doc, text in rows:
        x, hit, found = w(text), set(), set()
        for key, ids in windows.items():
            for i in range(len(x) - len(key) + 1):
                if tuple(x[i:i + len(key)]) == key:
                    hit |= set(range(i, i + len(key)))
                    found |= {str(j) for j in ids if j is not None}
        out[(doc, len(x), len(hit), tuple(sorted(found)))] += 1
    return out


def benchmark_items():
    t = dict(fixtures.texts())
    return [(1, " ".join(t[12].split()[5:40])), (2, "ONE, two"), (3, "z"), (4, None), (5, "..."), (6, "nowhere to be found"),
            (7, " ".join(t[13].split()[:10])), (7, " ".join(t[13].split()[:10])), (None, " ".join(t[14].split()[3:13])),
            (10, "same " * 30), (11, "日本語 😀"), (12, " ".join(t[12].split()[20:55]))]


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_decontamination_equals_brute_force(spark, docs, block_words):
    items = spark.createDataFrame([(i, t, "x") for i, t in benchmark_items()], "item_id long, text string, n_hit string")
    got = decontaminate.contamination(docs, items, block_words=block_words)
    found = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect())
    assert found == brute_hits(fixtures.texts(), benchmark_items())


# ---- op7: packing

def test_packing_holds_every_token_once(spark, docs):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    pieces = hilbert_pack.pack(docs, tokenizer_path(), max_tokens=64)
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    stream, texts = [], defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r["ids"]) == r.ids_crc32
        assert r.sequence_id * 64 + r.offset == len(stream) and r.offset + r.length <= 64
        stream += ids
        texts[(r.doc_id, r.doc_tokens)].append((r.start, ids))
    want = Counter((i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in fixtures.texts())
    got = Counter()
    for (doc, n), parts in texts.items():
        whole, copies = Counter(), sum(1 for s, _ in parts if s == 0)
        ids = [x for s, x in sorted(parts, key=lambda p: p[0])]
        if copies == 1:
            got[(doc, tuple(x for part in ids for x in part))] += 1
        else:  # repeated rows: their pieces differ only in where they are cut
            whole = Counter(x for part in ids for x in part)
            same = [k for k in want if k[0] == doc and len(k[1]) == n]
            assert whole == Counter(x for k in same for x in k[1] for _ in range(want[k]))
            got.update({k: want[k] for k in same})
    assert got == want
    padded = {r.sequence_id: r for r in hilbert_pack.sequences(pieces, 0, 64).collect()}
    last = max(padded)
    assert all(padded[k].n_tokens == 64 for k in padded if k != last)
    assert b"".join(padded[k]["ids"][:4 * padded[k].n_tokens] for k in sorted(padded)) == np.array(stream, "<u4").tobytes()


def test_chunk_encoder_equals_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(hilbert_pack, "CACHE_CHUNKS", 50)
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    odd = ["", " ", " a", "a ", "a  b", "\n", "a\n\nb", "a \nb", "a\n b", "a\tb c", "\ta", "a\t", "é\xa0b c", "x\n", "it's 'll 12a",
           "a　b c", "a\0b c", "\0", "\na b", "<|endoftext|> x", "x\r\ny", "日本 語", "a b"]
    own = hilbert_pack.ChunkEncoder(tokenizer_path())
    for group in (odd, [t or "" for _, t in fixtures.texts()], odd[::-1]):
        assert own.encode(group) == [np.array(e.ids, own.dtype).tobytes()
                                     for e in plain.encode_batch(group, add_special_tokens=False)]


def test_only_unknown_chunks_are_learned(monkeypatch):
    """Of a slice's distinct chunks those in the cache are looked up once and go no further."""
    own, learned = hilbert_pack.ChunkEncoder(tokenizer_path()), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda chunks: (learned.append(sorted(chunks)), learn(chunks))[1])
    first = own.encode(["one two, three.\nfour"])
    assert own.encode(["one two, three.\nfour"]) == first
    own.encode(["one five, three.\nfour"])
    assert learned[1:] == [[], ["five,"]]


def test_hilbert_curve_steps_by_one_cell():
    import itertools
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = hilbert_pack.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


# ---- op8: quality rules

def brute_base(text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))


def test_quality_base_and_verdict(spark):
    rows = fixtures.texts() + fixtures.junk() + [(800, "l one\nl one\n\n\nl one \nl two\nl one"), (801, "# * $ % & | < >")]
    docs = fixtures.documents(spark, rows)
    model = quality_lr.train(docs, fixtures.labels(spark))
    got = quality_lr.score(docs, model, carry=("doc_id", "text", "n_chars")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute_base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        assert r.base_failed == failed
        if r.doc_id in range(730, 760):  # unlabelled junk
            assert not r.kept
        elif r.doc_id in range(300, 312):  # unlabelled prose
            assert r.kept
    assert sum(r.kept and r.doc_id in range(700, 730) for r in got) == 0


def test_quality_without_labels_is_the_base(spark, docs):
    none = fixtures.labels(spark, [])
    assert quality_lr.train(docs, none) is None
    assert quality_lr.train(docs, fixtures.labels(spark, [(10 + i, 1) for i in range(9)])) is None
    got = quality_lr.score(docs, None)
    assert got.where("kept = base_failed").count() == 0


def test_quality_is_calibrated_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality_lr.train(docs, labels, max_train_rows=1_000)
    held = (labels.orderBy("doc_id").join(docs, "doc_id").select("doc_id", "text", "quality").toPandas())
    p = model.probability(held.text.tolist())
    assert ((p >= 0.5) == (held.quality == 1)).mean() > 0.97
    assert np.mean((p - held.quality) ** 2) < 0.03


def plain_fits(labelled):
    """Weights of the final model and of the two halves, fitted in one process on (text, label) by doc_id."""
    class Rows(list):
        y = np.array([y for _, y in labelled], dtype=float)

    rows = Rows()
    for text, _ in labelled:
        ids, n = np.unique(quality_lr.ngram_ids([text or ""])[1], return_counts=True)
        rows.append((ids, n / max(n.sum(), 1)))
    half = np.arange(len(rows)) % 2
    fits = [quality_lr._fit_weights(rows, np.flatnonzero(half != k)) for k in range(3)]
    margin = [fits[k][0][rows[i][0]] @ rows[i][1] + fits[k][1] for i, k in enumerate(half)]
    return fits[2], quality_lr._platt(np.array(margin), rows.y)


def test_quality_training_rows_stay_off_the_driver(spark, monkeypatch):
    rows = fixtures.texts() + fixtures.junk()
    docs, labels = fixtures.documents(spark, rows), fixtures.labels(spark)
    sent, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: sent.append(collect(df)) or sent[-1])
    model = quality_lr.train(docs, labels)
    monkeypatch.undo()
    assert sum(map(len, sent)) == 3  # models, not the 60 labelled rows
    texts = {i: t for i, t in rows if i is not None}
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in texts}
    (weights, bias), (slope, shift) = plain_fits([(texts[i], known[i]) for i in sorted(known)])
    assert np.allclose(model.weights, weights, rtol=1e-5, atol=1e-7)
    assert np.allclose([model.bias, model.slope, model.shift], [bias, slope, shift])


def test_quality_trains_on_texts_without_ngrams(spark):
    docs = fixtures.documents(spark, [(i, None if i % 3 else "") for i in range(8)])
    model = quality_lr.train(docs, fixtures.labels(spark, [(i, i // 2 % 2) for i in range(8)]))
    assert model is not None and not model.weights.any()
    assert quality_lr.score(docs, model).where("base_failed and not kept").count() == 8


# ---- op10: secrets

def test_base_spans_and_redaction():
    key, run = "AKIA" + "Q" * 16, "0123456789abcdef" * 2
    text = f'Token = "abc123" and password:x PASSWD : {run} {key} api_key=ABCDEF é😀 secret="short" tok {run[:23]}'
    got = secret_crf.base_spans(text)
    assert [(text[s:e], k) for s, e, k in got] == [
        ('Token = "abc123', "assign"), (f"PASSWD : {run}", "assign"), (run, "hex"), (key, "access"),
        ("api_key=ABCDEF", "assign")]
    masked = secret_crf.redact(text, [{"start": s, "end": e} for s, e, _ in got])
    assert run not in masked and key not in masked and "abc123" not in masked and masked.endswith(run[:23])
    assert secret_crf.base_spans(None) == [] and secret_crf.redact(None, []) is None


def test_viterbi_equals_exhaustive_search():
    import itertools
    r = np.random.default_rng(2)
    lengths = np.array([1, 4, 6, 2])
    scores, moves, start = r.normal(size=(13, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    m, s = secret_crf._masked(moves, start)
    at = 0
    for n, tags in zip(lengths, secret_crf.viterbi(scores, lengths, moves, start)):
        def total(path):
            return s[path[0]] + sum(scores[at + i, p] for i, p in enumerate(path)) + sum(
                m[a, b] for a, b in zip(path, path[1:]))
        assert tuple(tags) == max(itertools.product(range(3), repeat=int(n)), key=total)
        at += n


def test_field_finds_secrets_it_was_not_shown(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    field = secret_crf.train(docs.where("doc_id % 2 = 0"))  # a held-out half, not a row limit of the query
    held = docs.where("doc_id % 2 = 1").toPandas().text.tolist()
    hit = missed = extra = 0
    for text, spans in zip(held, secret_crf.Tagger(field).tag(held)):
        want = set(secret_crf.secret_values(text))
        hit, missed, extra = hit + len(want & set(spans)), missed + len(want - set(spans)), extra + len(set(spans) - want)
    assert hit >= 0.95 * (hit + missed) and extra <= 0.05 * hit
    new = ['the password is 8f3a9c1e7b2d4f6a8c0e1b3d5f7a9c1e2b4d6f80 okay', "plain words only here"]
    assert secret_crf.Tagger(field).tag(new)[1] == []


def test_scan_keeps_every_row(spark, docs):
    rows = [(i, t) for i, t in fixtures.texts() if not secret_crf.base_spans(t)]
    assert len(rows) < len(fixtures.texts())  # two are long runs of hex letters
    assert secret_crf.train(fixtures.documents(spark, rows)) is None  # no secret to learn from
    for field in (None, secret_crf.train(docs)):
        got = secret_crf.scan(docs, field, carry=("doc_id", "text", "n_chars"))
        assert rows_of(got, "doc_id", "text") == Counter(fixtures.texts())
        masked = rows_of(secret_crf.redact_documents(got), "doc_id", "text")
        assert sum(masked.values()) == len(fixtures.texts())
        assert Counter(rows) - masked == Counter()


# ---- all

def test_empty_tables(spark):
    docs = fixtures.documents(spark, [])
    assert suffix_dedup.dedup_substrings(docs).count() == 0
    assert minhash_dedup.near_duplicates(docs).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).count() == 0
    assert hilbert_pack.pack(docs, tokenizer_path()).count() == 0
    model = quality_lr.train(docs, fixtures.labels(spark, []))
    assert quality_lr.score(docs, model).count() == 0
    assert secret_crf.scan(docs, secret_crf.train(docs)).count() == 0


def test_empty_benchmark_leaves_all_clean(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("name", ["op2_minhash_dedup", "op5_decontaminate"])
def test_query_matches_oracle(spark, name):
    res = compare(spark, duck(SF_CHECK), name, SF_CHECK)
    assert res.get("match"), res
    assert "type_mismatch" not in res, res


def test_substring_query_equals_brute_force(spark):
    got = entry.queries()["op1_suffix_dedup"](spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(got, *got.columns) == brute_dedup(rows, 200)


def test_secret_query_counts_equal_plain_patterns(spark):
    got = {r.doc_id: r for r in entry.queries()["op10_secret_crf"](spark, SF_CHECK).collect()}
    rows = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for doc, text in rows:
        spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) > 5]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) > 19]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) > 23]
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        assert got[doc].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[doc].n_assign + got[doc].n_access + got[doc].n_hex == len(spans)
        assert set(said.split(",")) - {""} <= set(got[doc].spans.split(","))
    assert sum(r.n_hex for r in got.values()) > 0


def test_chunked_ids_are_the_tokenizers_on_any_white_space():
    import numpy as np
    from tokenizers import Tokenizer
    path = tokenizer_path()
    own, plain = hilbert_pack.ChunkEncoder(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    r = random.Random(8)
    pieces = [" ", "  ", "\t", "\n", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\x00", "word", "a", "10", "The", "é", "日本",
              "😀", ".", ",", ":", "'s", "'", "-", "_", "<|im_end|>", "\u200b", "\ufeff"]
    made = ["Total  due:\t10 EUR", "Price:  10\xa0EUR", "a  b\tc", "", " ", "\n", " a", "a\n", "a b\nc"]
    made += ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    for text, got in zip(made, own.encode(made)):
        assert np.frombuffer(got, own.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
