"""JSON files read in byte ranges: one array per file, or JSON Lines, with the place of every record.

An array file has no record separator that a reader could look for, so a multi-line
JSON file is one task.  Here Spark's text source cuts the file natively at every
``}`` (its splits are byte ranges of any store; a cut never falls inside a character
or an escape).  What a ``}`` means depends on what stands before it: inside a string
it is text, and outside the one that brings the depth back to 1 ends a record.
Every piece between two of them acts on that state in a known way, whatever the state:

* its unescaped quotes flip "inside a string" or leave it;
* the brackets that it holds outside strings change the depth, by one number if
  it begins outside a string and by another if it begins inside.

These are native expressions per piece.  Pass 1 sums them per block for both
starting states: one row per byte range, from which the driver (which plans the
ranges anyway) derives the state at the start of each range and the number of
records before it.  Pass 2 reads the ranges again with those states, in order within
each, and gives whole records as they are; only the record that crosses the border
of a range is put together by a shuffle.  Pieces are never parsed in Python.

The state after the last piece must be outside strings at depth 0, records must be
objects with one comma between, and each is parsed with ``FAILFAST``: a cut or broken file
fails the read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.session import ship_package


def _text(spark: SparkSession, paths: str | Sequence[str], separator: str, glob: str) -> DataFrame:
    """(file, block, value): the text between two separators, and the byte range that it begins in."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = (spark.read.option("lineSep", separator).option("pathGlobFilter", glob).option("recursiveFileLookup", False)
           .text(paths))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      "value")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _effects(pieces: DataFrame) -> DataFrame:
    """Add q (unescaped quotes) and d0, d1 (change of depth if the piece begins outside or inside a string)."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")

    def depth(text: Column) -> Column:
        outside = F.regexp_replace(text, r'"[^"]*("|\z)', "")
        return _count(outside, "{[") - _count(outside, "]")

    return pieces.select("*", _count(bare, '"').alias("q"), depth(bare).alias("d0"),
                         depth(F.concat(F.lit('"'), bare)).alias("d1"))


def _runs(batch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """((file, block), start, end) of the neighbouring rows of a batch that share both."""
    import numpy as np
    import pyarrow.compute as pc
    blocks = batch.column("block").to_numpy()
    files = pc.dictionary_encode(batch.column("file"))
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1
    bounds = [0, *cuts.tolist(), len(blocks)]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield (files.dictionary[int(codes[a])].as_py(), int(blocks[a])), a, b


class _State:
    """Inside a string or not, depth, and whether the next piece is the first of its file."""

    def __init__(self, inside: int, depth: int, first: bool):
        self.inside, self.depth, self.first = inside, depth, first

    def step(self, q, d0, d1):
        """(a ``}`` outside strings precedes the piece, the depth after it) per piece; the state moves on."""
        import numpy as np
        outside = (np.cumsum(q) - q + self.inside) & 1 == 0
        close = outside.copy()
        if self.first:
            close[0], self.first = False, False
        change = np.where(outside, d0, d1)
        depth = self.depth + np.cumsum(change) - change - np.cumsum(close)
        self.inside = (self.inside + int(q.sum())) & 1
        self.depth += int(change.sum()) - int(close.sum())
        return close, depth


def _numbers(batch, a: int, b: int):
    return [batch.column(c).to_numpy()[a:b].astype("int64") for c in ("q", "d0", "d1")]


def _summaries(batches: Iterator) -> Iterator:
    """Per range and starting state: how the state ends, and how often a ``}`` leaves each depth."""
    from collections import Counter

    import pyarrow as pa
    held, key = None, None

    def out():
        (file, block), states = key, held
        return pa.RecordBatch.from_pydict({
            "file": [file] * 2, "block": [block] * 2, "inside": [0, 1],
            "inside_after": [s.inside for s, _ in states], "depth_after": [s.depth for s, _ in states],
            "depths": [list(n) for _, n in states], "closes": [list(n.values()) for _, n in states]}, _SUMMARY)

    _SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.int32()),
                          ("inside_after", pa.int32()), ("depth_after", pa.int64()),
                          ("depths", pa.list_(pa.int64())), ("closes", pa.list_(pa.int64()))])
    for batch in batches:
        for run, a, b in _runs(batch):
            if run != key:
                if key is not None:
                    yield out()
                key, held = run, [(_State(s, 0, run[1] == 0), Counter()) for s in (0, 1)]
            for state, n in held:
                close, depth = state.step(*_numbers(batch, a, b))
                n.update(depth[close].tolist())
    if key is not None:
        yield out()


def _range_states(pieces: DataFrame) -> tuple[dict, dict]:
    """{(file, block): (inside, depth, records before)} and {file: records}; raises where a file ends early."""
    schema = ("file string, block long, inside int, inside_after int, depth_after long, depths array<long>, "
              "closes array<long>")
    found: dict[str, dict] = {}
    for r in pieces.select("file", "block", "q", "d0", "d1").mapInArrow(_summaries, schema).toLocalIterator():
        found.setdefault(r["file"], {}).setdefault(r["block"], {})[r["inside"]] = r
    states, records = {}, {}
    for file, blocks in found.items():
        inside, depth, n = 0, 0, 0
        for block in sorted(blocks):
            states[file, block] = (inside, depth, n)
            r = blocks[block][inside]
            n += dict(zip(r["depths"], r["closes"])).get(1 - depth, 0)
            inside, depth = r["inside_after"], depth + r["depth_after"]
        if inside or depth:
            raise ValueError(f"not a whole JSON array: {file}")
        records[file] = n
    return states, records


def read_array_records(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.json") -> DataFrame:
    """(file, position, text) of every record of the array files; ``position`` is its 0-based place in the array.

    One job runs here: the states at the start of the byte ranges (a row per range).
    """
    ship_package(spark)
    pieces = _effects(_text(spark, paths, "}", glob))
    states, records = _range_states(pieces)
    known = spark.sparkContext.broadcast((states, records))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from dialframe.sources import json_array
        states, records = known.value
        key, state, number, parts, begun, rows = None, None, 0, [], False, []

        def close_range():
            rows.append((key[0], number, key[1], False, number >= records[key[0]], "}".join(parts)))

        def out():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, _TYPES)], _NAMES)
            rows.clear()
            return batch

        _NAMES = ["file", "position", "block", "whole", "trailer", "text"]
        _TYPES = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        for batch in batches:
            values = batch.column("value").to_pylist()
            for run, a, b in json_array._runs(batch):
                if run != key:
                    if key is not None:
                        close_range()
                    key, (inside, depth, number) = run, states[run]
                    begun = run[1] == 0
                    state, parts = json_array._State(inside, depth, begun), [] if begun else [""]
                close, depth = state.step(*json_array._numbers(batch, a, b))
                last = a
                for i in (a + (close & (depth == 1)).nonzero()[0]).tolist():
                    parts += values[last:i]
                    rows.append((key[0], number, key[1], begun, False, "}".join(parts) + "}"))
                    number, parts, begun, last = number + 1, [], True, i
                parts += values[last:b]
            yield out()
        if key is not None:
            close_range()
            yield out()

    found = pieces.mapInArrow(cut, "file string, position long, block long, whole boolean, trailer boolean, text string")
    across = found.where("not whole").groupBy("file", "position", "trailer").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts")).select(
        "file", "position", "trailer", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    end = r"^[\s\x{FEFF}]*(\[\s*)?\]\s*\z"
    across = across.select("file", "position", F.explode(F.filter(F.array(
        F.when(~F.col("trailer"), F.col("text")).when(~F.col("text").rlike(end), F.raise_error(
            F.concat(F.lit("not a whole JSON array: "), "file")))), lambda t: t.isNotNull())).alias("text"))
    records = found.where("whole").select("file", "position", "text").unionByName(across)
    # What stands before a record: the array's bracket before the first, one comma before any other.
    before = F.when(F.col("position") == 0, F.regexp_extract("text", r"^[\s\x{FEFF}]*\[\s*(?=\{)", 0)).otherwise(
        F.regexp_extract("text", r"^\s*,\s*(?=\{)", 0))
    rest = F.when(before == "", F.raise_error(F.concat(F.lit("not an array of objects: "), "file"))).otherwise(
        F.substr("text", F.length(before) + 1))
    return records.select("file", "position", rest.alias("text"))


def read_line_records(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.json") -> DataFrame:
    """(file, position, text) of every line that is not blank; ``position`` counts over a folder's files by name.

    One job runs here: lines per byte range (a row per range).
    """
    lines = _text(spark, paths, "\n", glob).where(F.trim("value", F.lit(" \t\r")) != "").withColumn(
        "_row", F.monotonically_increasing_id())
    ranges = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first")).collect()
    starts, before = [], {}
    for r in sorted(ranges, key=lambda r: (r["file"], r["block"])):
        folder = r["file"].rpartition("/")[0]
        starts.append((r["file"], r["block"], before.get(folder, 0) - r["first"]))
        before[folder] = before.get(folder, 0) + r["n"]
    moved = spark.createDataFrame(starts, "file string, block long, shift long")
    return lines.join(moved, ["file", "block"]).select(
        "file", (F.col("_row") + F.col("shift")).alias("position"), F.col("value").alias("text"))


def parse_records(records: DataFrame, schema: str, keep: Sequence[str] = ("file", "position")) -> DataFrame:
    """``keep`` and the fields of ``schema`` of the records' text; broken text fails the read.

    The generator keeps conditions on the fields above the parser: they would be pushed
    into it and parse every record again, those that are no records included.
    """
    value = F.explode(F.array(F.from_json("text", schema, {"mode": "FAILFAST"})))
    return records.select(*keep, value.alias("_v")).select(*keep, "_v.*")
