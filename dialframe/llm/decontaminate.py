"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

A benchmark item's windows are its runs of ``window`` consecutive words (the
whole item where it has fewer).  Each window is a set of positioned shingles of
``shingle`` words.  Shingles are ordered by rarity, counted over all documents.
A window that a document contains must share all its shingles with it, so the
necessary prefix is one token long: its rarest shingle.  Document shingles are
joined with these prefix tokens only; length and position bounds drop matches
where the window would begin before the document or end after it; the remaining
ones are verified word by word.

Benchmark items go out in blocks of at most ``block_words`` words; that bounds
what is broadcast and what a worker holds.  A larger benchmark is more blocks
and so more passes, never a larger broadcast.

Defined results: null or wordless texts have no words and no hit; a null item id
is not reported in the item list but its windows count; repeated items are one;
repeated rows are judged each; an empty benchmark leaves every document clean;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialframe.llm.common import map_batches, pick, slices

WINDOW = 10
SHINGLE = 3
BLOCK_WORDS = 200_000

# Words are cut at the bytes 00-2F, 3A-60 and 7B-7F, after A-Z (41-5A) went to lower case.
_CUT = bytes(0x20 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F
             else c + 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: A-Z lower-cased, cut at every ASCII character that is no letter or digit."""
    return text.encode("utf-8", "surrogatepass").translate(_CUT).split() if text else []


@dataclass
class Block:
    """Windows of some items: the word numbers of each, its items, and its shingles."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: list[tuple[int, ...]] = field(default_factory=list)
    items: list[list] = field(default_factory=list)
    shingles: dict[tuple[int, ...], int] = field(default_factory=dict)
    #: Rarest shingle -> [(window, offset of the shingle in it)], by shingle length.
    prefix: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = field(default_factory=dict)

    def parts(self, window: tuple[int, ...]) -> list[tuple[int, ...]]:
        """The window's shingles in order; a window shorter than a shingle is one."""
        n = min(SHINGLE, len(window))
        return [window[i:i + n] for i in range(len(window) - n + 1)]


def build_block(items: list[tuple[object, str | None]], window: int = WINDOW) -> Block:
    """Windows and shingles of (item_id, text) rows; word numbers begin at 1."""
    block, of = Block(), {}
    for item_id, text in sorted(set(items), key=lambda x: (str(x[0]), x[1] or "")):
        ids = [block.vocabulary.setdefault(w, len(block.vocabulary) + 1) for w in words_of(text)]
        n = min(window, len(ids))
        for i in range(len(ids) - n + 1) if n else ():
            key = tuple(ids[i:i + n])
            if key not in of:
                of[key] = len(block.windows)
                block.windows.append(key)
                block.items.append([])
            if item_id is not None and item_id not in block.items[of[key]]:
                block.items[of[key]].append(item_id)
    for w in block.windows:
        for s in block.parts(w):
            block.shingles.setdefault(s, len(block.shingles))
    return block


def set_prefixes(block: Block, counts: dict[int, int]) -> Block:
    """Order each window's shingles by rarity and keep the rarest as its prefix token."""
    for k, w in enumerate(block.windows):
        parts = block.parts(w)
        rarest = min(range(len(parts)), key=lambda i: (counts.get(block.shingles[parts[i]], 0), parts[i], i))
        block.prefix.setdefault(len(parts[rarest]), {}).setdefault(parts[rarest], []).append((k, rarest))
    return block


def _packed(names: np.ndarray, n: int, base: int) -> np.ndarray:
    """One number for the n-word shingle at each position; 0 where a word is not of the benchmark."""
    if len(names) < n:
        return np.zeros(0, dtype=np.int64)
    last = len(names) - n + 1
    key, known = np.zeros(last, dtype=np.int64), np.ones(last, dtype=bool)
    for i in range(n):
        part = names[i:i + last]
        key = key * base + part
        known &= part > 0
    return np.where(known, key, 0)


def _names(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    get = vocabulary.get
    return np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))


def _pack_key(shingle: tuple[int, ...], base: int) -> int:
    key = 0
    for w in shingle:
        key = key * base + w
    return key


def rarity(docs: DataFrame, block: Block) -> dict[int, int]:
    """Occurrences of each of the block's shingles over all documents (bounded by the block)."""
    shared = docs.sparkSession.sparkContext.broadcast((block.vocabulary, block.shingles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, shingles = shared.value
        base = len(vocabulary) + 1
        tables = {}
        for n in sorted({len(s) for s in shingles}):
            pairs = sorted((_pack_key(s, base), i) for s, i in shingles.items() if len(s) == n)
            tables[n] = (np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        total = np.zeros(len(shingles), dtype=np.int64)
        for b in slices(batches, "text"):
            for text in b.column("text").to_pylist():
                names = _names(words_of(text), vocabulary)
                for n, (keys, ids) in tables.items():
                    packed = _packed(names, n, base)
                    packed = packed[packed > 0]
                    if len(packed):
                        at = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
                        hit = keys[at] == packed
                        total += np.bincount(ids[at[hit]], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "n"])

    counted = map_batches(docs.select("text"), run, "shingle long, n long")
    return {r.shingle: r.n for r in counted.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}


def _matches(words: list[bytes], block: Block, tables: dict) -> list[tuple[int, int]]:
    """(window, start) of every verified occurrence in one document."""
    names, base, found = _names(words, block.vocabulary), len(block.vocabulary) + 1, []
    for n, (keys, lists) in tables.items():
        packed = _packed(names, n, base)
        known = np.flatnonzero(packed)
        if not len(known):
            continue
        at = np.minimum(np.searchsorted(keys, packed[known]), len(keys) - 1)
        same = keys[at] == packed[known]
        for pos, slot in zip(known[same].tolist(), at[same].tolist()):
            for k, offset in lists[slot]:
                start, window = pos - offset, block.windows[k]
                if start < 0 or start + len(window) > len(names):  # length and position bounds
                    continue
                if tuple(names[start:start + len(window)].tolist()) == window:
                    found.append((k, start))
    return found


def _merged(ranges: list[int]) -> list[int]:
    """Flat [start, end) pairs as disjoint pairs in order."""
    out: list[int] = []
    for start, end in sorted(zip(ranges[::2], ranges[1::2])):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _hits(docs: DataFrame, block: Block, carry: list[str]) -> DataFrame:
    """One pass: adds the block's hit word ranges and item ids to those found by earlier passes."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk = shared.value
        base = len(blk.vocabulary) + 1
        tables = {}
        for n, prefix in blk.prefix.items():
            pairs = sorted((_pack_key(s, base), s) for s in prefix)
            tables[n] = (np.array([p[0] for p in pairs]), [prefix[p[1]] for p in pairs])
        for b in slices(batches, "text"):
            counts, ranges, items = [], [], []
            earlier = zip(b.column("text").to_pylist(), b.column("_ranges").to_pylist(), b.column("_items").to_pylist())
            for text, old_ranges, old_items in earlier:
                words = words_of(text)
                found = _matches(words, blk, tables)
                flat = [x for k, s in found for x in (s, s + len(blk.windows[k]))]
                counts.append(len(words))
                ranges.append(_merged(old_ranges + flat))
                items.append(sorted({*old_items, *(str(i) for k, _ in found for i in blk.items[k])}))
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in carry] + [pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.int64())),
                                                pa.array(items, pa.list_(pa.string()))],
                names=[*carry, "_words", "_ranges", "_items"])

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in carry),
                        "_words long, _ranges array<long>, _items array<string>"])
    return map_batches(docs, run, schema)


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """Distinct (item_id, text) rows in blocks of at most ``block_words`` words (one item at least)."""
    rows, total = [], 0
    for r in pick(benchmark, item_id="item_id", text="text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(r.text))
        if rows and total + n > block_words:
            yield rows
            rows, total = [], 0
        rows.append((r.item_id, r.text))
        total += n
    if rows:
        yield rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",),
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document row with n_words, n_hit and items (ids as strings, sorted).

    ``docs`` needs a ``text`` column; ``carry`` names the columns to return.
    """
    names = list(dict.fromkeys([*carry, "text"]))
    texts = docs.select(*[F.col(f"`{n}`") for n in names])
    blocks = [set_prefixes(b, rarity(texts, b)) for b in
              (build_block(rows, window) for rows in benchmark_blocks(benchmark, block_words))] or [Block()]
    found = texts.withColumns({"_ranges": F.array().cast("array<long>"), "_items": F.array().cast("array<string>")})
    for k, block in enumerate(blocks):
        found = _hits(found.select(*[F.col(f"`{n}`") for n in names], "_ranges", "_items"), block,
                      list(carry) if k == len(blocks) - 1 else names)
    hit = F.aggregate(F.transform("_ranges", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
                      F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(*[F.col(f"`{n}`") for n in carry], F.col("_words").alias("n_words"), hit.alias("n_hit"),
                        F.col("_items").alias("items"))
