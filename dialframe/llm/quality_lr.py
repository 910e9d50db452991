"""Quality rules: counted base rules, then a hashed n-gram logistic regression with calibrated probability.

The model is trained on labelled quality rows: word 1- and 2-grams and character
2- to 4-grams are hashed to :data:`DIMS` weights; a text's margin is the mean
weight of its n-grams plus a bias.  Probabilities are calibrated by a logistic
fit (Platt) on margins that two cross-fitted models give to rows they have not
seen.  Documents are scored in Arrow batches against a fixed threshold.

Training uses at most ``max_train_rows`` labelled rows, the first by hash of the
id.  The two cross-fitted models and the final one are three groups of Spark, each
with these rows on its task's disk; the driver gets weights and margins only.
Counting and scoring cover every document and its whole text.

Defined results: a null text has no words and fails the base; repeated rows are
judged one by one; without labelled rows of both classes there is no model and
the base alone decides; labels that are null are not used; of several labels of
an id the smallest counts; extra columns are ignored.
"""

from __future__ import annotations

import re
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialframe.llm.common import give_back_memory, map_batches, pick, slices

DIMS = 1 << 16
MAX_TRAIN_ROWS = 3_000
#: Text whose n-grams a task holds at a time: some 200 bytes of arrays for each of its characters.
SLICE_BYTES = 500_000
#: Rows are kept from this calibrated probability on; below one half, so that doubtful short texts stay.
THRESHOLD = 0.3
WORD = re.compile("[^\x20\x09-\x0D]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
_EPOCHS, _RATE = 12, 0.5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by ``window``-word windows found twice or more in the text (exact: names are doubled)."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    names = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    span = 1
    while span < window:  # the name of a window of 2 * span words is that of its halves
        step = min(span, window - span)
        names = names[:len(names) - step] * n + names[step:]
        names = np.unique(names, return_inverse=True)[1]
        span += step
    again = np.bincount(names)[names] > 1
    if not again.any():
        return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at exactly these six characters
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def ngram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed n-gram) of every word 1-, 2-gram and character 2-, 3-, 4-gram of the texts."""
    rows, ids = [], []
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    h = code * np.uint32(0x9E3779B1)
    for n in (2, 3, 4):
        if len(code) < n:
            break
        h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ (code[n - 1:] * np.uint32(0x9E3779B1))
        same = of[n - 1:] == of[:len(of) - n + 1]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        ids.append((mixed >> np.uint32(16))[same].astype(np.int32))
        rows.append(of[:len(of) - n + 1][same])
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    per = np.array([len(w) for w in words], dtype=np.int64)
    one = np.fromiter((zlib.crc32(w) for ws in words for w in ws), dtype=np.uint32, count=int(per.sum()))
    wrow = np.repeat(np.arange(len(texts), dtype=np.int32), per)
    mixed = one * np.uint32(0x27D4EB2F)
    ids.append((mixed >> np.uint32(16)).astype(np.int32))
    rows.append(wrow)
    if len(one) > 1:
        two = (one[:-1] * np.uint32(0x85EBCA6B) ^ one[1:]) * np.uint32(0x165667B1)
        same = wrow[1:] == wrow[:-1]
        ids.append((two >> np.uint32(16))[same].astype(np.int32))
        rows.append(wrow[1:][same])
    return np.concatenate(rows), np.concatenate(ids)


@dataclass(frozen=True)
class QualityModel:
    """Weights per hashed n-gram, bias, and the calibration ``sigmoid(slope * margin + shift)``."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: list[str]) -> np.ndarray:
        row, gram = ngram_ids(texts)
        n = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        return np.bincount(row, weights=self.weights[gram], minlength=len(texts)) / n + self.bias

    def probability(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -60, 60)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class _SparseRows:
    """A group's sparse rows (ids, relative counts) by doc_id: numbers in memory, n-grams in two files of the task."""

    def __init__(self, batches: Iterator[pa.RecordBatch], ids_file, counts_file):
        doc_id, label, sizes, fit = [], [], [], []
        for b in batches:
            for packed, file in (("ids", ids_file), ("counts", counts_file)):
                for x in b.column(packed):
                    file.write(x.as_buffer())
            doc_id += b.column("doc_id").to_pylist()
            label += b.column("label").to_pylist()
            sizes += pa.compute.binary_length(b.column("ids")).to_pylist()
            fit = b.column("fit").to_pylist()[:1] or fit
        self.fit = fit[0]
        order = np.argsort(np.array(doc_id, dtype=np.int64))
        ends = np.cumsum(np.array(sizes, dtype=np.int64) // 2)
        self.ends, self.starts = ends[order], ends[order] - np.array(sizes, dtype=np.int64)[order] // 2
        self.y = np.array(label, dtype=float)[order]
        for file in (ids_file, counts_file):
            file.flush()
        empty = not ends[-1]  # no map of an empty file
        self.ids = np.zeros(0, "<u2") if empty else np.memmap(ids_file, "<u2", mode="r")
        self.counts = np.zeros(0, "<u4") if empty else np.memmap(counts_file, "<u4", mode="r")

    def __len__(self) -> int:
        return len(self.y)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[i], self.ends[i])
        c = np.asarray(self.counts[part]).astype(float)
        return np.asarray(self.ids[part]).astype(np.int64), c / max(c.sum(), 1)


def _fit_weights(rows: _SparseRows, on: np.ndarray) -> tuple[np.ndarray, float]:
    """AdaGrad over the sparse rows numbered ``on``, classes weighted alike."""
    y = rows.y[on]
    w, g2 = np.zeros(DIMS), np.full(DIMS, 1e-8)
    bias, b2 = 0.0, 1e-8
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    order = np.random.default_rng(7)
    for _ in range(_EPOCHS):
        for i in order.permutation(len(on)):
            ids, x = rows[on[i]]
            err = (_sigmoid(w[ids] @ x + bias) - y[i]) * weight[i]
            step = err * x
            g2[ids] += step * step
            w[ids] -= _RATE * step / np.sqrt(g2[ids])
            b2 += err * err
            bias -= 0.05 * err / np.sqrt(b2)
    return w, bias


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton fit of sigmoid(slope * margin + shift) with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ theta)
        grad = x.T @ (p - target)
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as sparse rows: the n-gram ids and counts as packed bytes."""
    for b in slices(batches, "text", SLICE_BYTES):
        texts = [t or "" for t in b.column("text").to_pylist()]
        row, gram = ngram_ids(texts)
        ids, cnt = [], []
        key, n = np.unique(row.astype(np.int64) * DIMS + gram, return_counts=True)
        cut = np.searchsorted(key, np.arange(len(texts) + 1) * DIMS)
        for i in range(len(texts)):
            part = slice(cut[i], cut[i + 1])
            ids.append((key[part] - i * DIMS).astype("<u2").tobytes())
            cnt.append(n[part].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("label"), pa.array(ids, pa.binary()), pa.array(cnt, pa.binary())],
            names=["doc_id", "label", "ids", "counts"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's model: without one half of its rows (0 or 1), to which it gives margins, or on all (2)."""
    with tempfile.TemporaryFile() as ids_file, tempfile.TemporaryFile() as counts_file:
        rows = _SparseRows(batches, ids_file, counts_file)
        half = np.arange(len(rows)) % 2
        on = np.flatnonzero(half != rows.fit)
        weights, bias, margins = None, None, None
        if len(rows) >= 4 and rows.y[on].min() != rows.y[on].max():
            w, bias = _fit_weights(rows, on)
            unseen = (rows[i] for i in np.flatnonzero(half == rows.fit))
            margins = np.array([w[ids] @ x + bias for ids, x in unseen], dtype=float).tobytes()
            weights = w.astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows.fit], pa.int32()), pa.array([rows.y.tobytes()], pa.binary()),
             pa.array([weights], pa.binary()), pa.array([bias], pa.float64()), pa.array([margins], pa.binary())],
            names=["fit", "labels", "weights", "bias", "margins"])
        del rows
    give_back_memory()


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> QualityModel | None:
    """Fit on at most ``max_train_rows`` labelled documents (doc_id, text) x (doc_id, quality)."""
    first = (pick(labels, doc_id="doc_id", label="quality").where("label in (0, 1) and doc_id is not null")
             .groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows))
    rows = (pick(docs, doc_id="doc_id", text="text")
            .join(F.broadcast(first), "doc_id"))  # at most max_train_rows pairs of numbers
    # An id may name several rows: one of them, whichever text is smallest, so that the bound holds.
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sparse = map_batches(rows, _train_batches, "doc_id long, label int, ids binary, counts binary")
    each = sparse.withColumn("fit", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    fits = each.groupBy("fit").applyInArrow(
        _fit, "fit int, labels binary, weights binary, bias double, margins binary").collect()
    if not fits or any(r.weights is None for r in fits):
        return None
    *crossed, last = sorted(fits, key=lambda r: r.fit)
    y = np.frombuffer(last.labels)
    margin = np.zeros(len(y))
    for r in crossed:
        margin[r.fit::2] = np.frombuffer(r.margins)
    slope, shift = _platt(margin, y)
    return QualityModel(np.frombuffer(last.weights, np.float32), last.bias, slope, shift)


def score(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD,
          carry: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Every row of ``docs`` with its base counts, probability (null without a model) and ``kept``.

    ``carry`` names the columns returned beside them; ``text`` must be among the columns of ``docs``.
    """
    # The model is some 256 KB: its size is fixed by DIMS, not by the data.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys([*carry, "text"]))
    kinds = dict(docs.select(*[F.col(f"`{n}`") for n in names]).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text", SLICE_BYTES):
            texts = b.column("text").to_pylist()
            base = list(zip(*[base_counts(t) for t in texts])) or [()] * 5
            words, repeated = np.array(base[0], np.int64), np.array(base[4], np.int64)
            failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)
            p = m.probability([t or "" for t in texts]) if m is not None else None
            kept = ~failed if p is None else ~failed & (p >= threshold)
            out = [b.column(n) for n in carry] + [pa.array(c, pa.int64()) for c in base]
            out += [pa.array(failed), pa.array(p if p is not None else [None] * len(texts), pa.float64()),
                    pa.array(kept)]
            yield pa.RecordBatch.from_arrays(out, names=[*carry, *BASE, "base_failed", "probability", "kept"])

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in carry), *(f"{n} long" for n in BASE),
                        "base_failed boolean, probability double, kept boolean"])
    return map_batches(docs.select(*[F.col(f"`{n}`") for n in names]), run, schema)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
