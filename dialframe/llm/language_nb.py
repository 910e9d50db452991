"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, and its 1-, 2- and 3-grams of code points (with a space
before and two after the text) are hashed to a fixed number of buckets.  Training counts
buckets per language over all training documents: every task sums its own
documents, Spark adds the tasks' sums, and the smoothed log-probabilities, one row
per bucket, are broadcast.  Scoring takes a text's buckets as a sparse row and
multiplies it with that matrix in numpy, a bounded piece of text at a time, over the whole
text; the score is the posterior probability of the language predicted.

The matrix is bounded: ``BUCKETS`` x languages is halved until it has at most
``CELLS`` cells, so the broadcast never exceeds 32 MB.

Cases: a null text, one without a letter, or one judged by a model that has learned nothing
is ``und`` with score 0.  Ties go to the language whose name sorts first.  Documents
without language do not train.  Repeated rows each count and are each judged.  A null id is not held out.
An empty table gives an empty result.  More than ``CELLS / 256`` languages raise: such a column names no languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialframe.llm.common import map_batches, pick, slices

BUCKETS = 1 << 16
CELLS = 1 << 22
ORDERS = 3
SMOOTHING = 0.1
UNKNOWN = "und"
#: Positions whose buckets are looked up at a time.
PIECE = 1 << 18
#: Languages whose counts a task holds at a time.
HELD = 32
# Odd multipliers, fixed values of the hash.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@dataclass
class Model:
    """``languages`` in order, ``log_probability`` (buckets, languages) and ``log_prior`` (languages)."""

    languages: list[str]
    log_probability: np.ndarray
    log_prior: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.log_probability)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def buckets_of(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(ORDERS, positions) buckets of the n-grams that start at each position, and where each text starts.

    A text has one position for its leading space and one per code point.  What follows
    the last position of a text (two spaces) starts no n-gram: its columns belong to no text.
    """
    lowered = [t.lower() for t in texts]
    blob = np.frombuffer("".join(f" {t}  " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 3 for t in lowered], np.int64)
    n = len(blob) - 2
    shift = np.uint32(32 - buckets.bit_length() + 1)
    out, rolling = np.empty((ORDERS, n), np.uint32), np.zeros(n, np.uint32)
    for k in range(ORDERS):
        rolling = (rolling ^ blob[k:n + k]) * np.uint32(_MULTIPLIERS[k])
        rolling ^= rolling >> np.uint32(15)
        out[k] = (rolling * np.uint32(_MULTIPLIERS[0])) >> shift
    return out, np.cumsum(sizes) - sizes


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t if t is not None else "" for t in batch.column("text").to_pylist()]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS,
          smoothing: float = SMOOTHING) -> Model:
    """Counts over all of ``docs`` that have a language; pass training documents only."""
    docs = pick(docs, text=text, lang=lang).where("lang is not null")
    per_language = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
                    .limit(CELLS // 256 + 1).collect()}
    if len(per_language) > CELLS // 256:
        raise ValueError(f"more than {CELLS // 256} languages")
    languages = sorted(per_language)
    while languages and buckets * len(languages) > CELLS:
        buckets //= 2
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for code, n in held.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), code, np.int32)),
                                                  pa.array(some.astype(np.int32)), pa.array(n[some])],
                                                 ["code", "bucket", "n"])
            held.clear()

        for batch in slices(batches, "text"):
            grams, starts = buckets_of(_texts(batch), buckets)
            ends = np.append(starts[1:], grams.shape[1] + 2) - 2
            for i, name in enumerate(batch.column("lang").to_pylist()):
                code = place[name]
                if code not in held:
                    if len(held) >= HELD:
                        yield from out()
                    held[code] = np.zeros(buckets, np.int64)
                found, n = np.unique(grams[:, starts[i]:ends[i]], return_counts=True)
                held[code][found] += n
        yield from out()

    counts = map_batches(docs, count, "code int, bucket int, n long").groupBy("code", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((buckets, len(languages)))
    if languages:
        got = counts.toArrow()  # at most CELLS rows
        table[got.column("bucket").to_numpy(), got.column("code").to_numpy()] = got.column("n").to_numpy()
    documents = np.array([per_language[x] for x in languages], float)
    table += smoothing
    return Model(languages, np.log(table / table.sum(0)) if languages else table,
                 np.log(documents / documents.sum()) if languages else documents)


def log_scores(texts: list[str], model: Model) -> np.ndarray:
    """(texts, languages) joint log-probabilities."""
    out = np.tile(model.log_prior, (len(texts), 1))
    if not texts:
        return out
    grams, starts = buckets_of(texts, model.buckets)
    # Segments: a text's positions, then its two trailing ones, which count nothing.
    bounds = np.stack([starts, np.append(starts[1:], grams.shape[1] + 2) - 2], axis=1).ravel()
    for at in range(0, grams.shape[1], PIECE):
        piece = grams[:, at:at + PIECE]
        value = model.log_probability[piece[0]]
        for row in piece[1:]:
            value += model.log_probability[row]
        # Bounds inside the piece; the segment that began before it goes on at 0.
        first, last = np.searchsorted(bounds, [at, at + piece.shape[1]], side="left")
        cuts, segment = bounds[first:last] - at, np.arange(first, last)
        if len(cuts) == 0 or cuts[0] != 0:
            cuts, segment = np.append(0, cuts), np.append(first - 1, segment)
        sums = np.add.reduceat(value, cuts, axis=0)
        mine = segment % 2 == 0
        np.add.at(out, segment[mine] // 2, sums[mine])
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, ``lang_pred`` and ``score`` (rounded to 6 digits) of every document."""
    docs = docs.select(*[F.col(f"`{c}`") for c in carry if c != text], F.col(f"`{text}`").alias("text"))
    kept = [f for f in docs.schema.fields if f.name in carry]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast((model.log_probability, model.log_prior))
    languages = model.languages

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        letter = regex.compile(r"\p{L}")
        here = Model(languages, *shared.value)
        for batch in slices(batches, "text"):
            texts = _texts(batch)
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if languages and letter.search(t)]
            if known:
                joint = log_scores([texts[i] for i in known], here)
                best = joint.argmax(1)
                share = 1 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
                scores[known] = np.round(share, 6)
                for i, b in zip(known, best):
                    names[i] = languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept]
                                             + [pa.array(names, pa.string()), pa.array(scores)],
                                             [f.name for f in kept] + ["lang_pred", "score"])

    return map_batches(docs, judge, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on the documents that are not held out, over all documents."""
    docs = pick(docs, doc_id=doc_id, text=text, lang=lang)
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
