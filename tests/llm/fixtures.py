"""Small documents with the awkward cases: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

#: Columns that operators use inside, with values that would break a result if they were picked up.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, label string, "
          "kept string, component string, ids string, anchor string, spans string, a string, b string, n int")
CLASH = (-7, "x", "x", "x", "x", "x", "x", "x", "x", "x", -7)


def words(seed: int, n: int, size: int = 400) -> list[str]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(size)]
    return [r.choice(vocabulary) for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): plain prose, copies, near copies, shared passages and odd texts."""
    rows: list[tuple[int | None, str | None]] = []
    base = [" ".join(words(i, 120 + 5 * i)) for i in range(30)]
    rows += [(10 + i, t) for i, t in enumerate(base)]
    rows += [(100, base[3]), (101, base[3].upper()), (102, base[3] + " tail word"), (103, base[3][5:])]
    for k in range(25):  # a group of near copies that drifts
        w = base[7].split()
        for i in range(k // 3):
            w[(i * 31) % len(w)] = f"new{i}"
        rows.append((200 + k, " ".join(w)))
    passage = " ".join(words(77, 60))
    rows += [(300 + k, " ".join(words(500 + k, 40)) + "\n" + passage + "\n" + " ".join(words(600 + k, 30)))
             for k in range(12)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one two"), (404, "One  two\n"), (405, "é ü ß 日本語 😀 " * 30),
             (406, "same " * 300), (407, "=" * 3000), (408, " ".join(words(9, 6000, 3000))), (409, "a" * 199),
             (410, "ab" * 120), (411, "x y z"), (412, "\x00 nul \x0b tab\x0cpage " * 20)]
    rows += [(413, base[4]), (413, base[4]), (414, None), (414, None), (None, base[5]), (None, None)]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, "en", None if i is None else f"s{i % 3}", None if t is None else len(t), *CLASH) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA)


def labels(spark, rows=None):
    """Quality labels for some rows: the symbol-ridden junk below is bad, prose is good."""
    if rows is None:
        rows = [(10 + i, 1) for i in range(30)] + [(700 + i, 0) for i in range(30)] + [(None, 1), (10, None), (9999, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int")


def junk() -> list[tuple[int, str]]:
    return [(700 + i, " ".join(w + "$$$%%"[i % 3:] for w in words(900 + i, 60))) for i in range(60)]
