"""File sources and sinks: example JSON, refined JSON, length CSV, prediction sets.

* Examples arrive as UTF-8 files holding one JSON array each (``*.json`` in a
  directory, split = file stem).  They are read in byte ranges, so one large file is
  many tasks; Parquet partitioned by split is the faster form for repeated use.
* ``position`` is an example's place in its file (array), or in its split's files by
  name (JSON Lines); it is kept at ingest and in refined output, and is the file order
  that folds go by.
* ``utterance_id`` is a string in raw data and a string *or* a list after
  merging; it is read as ``variant`` and normalised to ``array<string>``, and
  written back with singletons unwrapped.
* A prediction set is a file with one JSON array, a JSON Lines file, or a folder
  of JSON Lines written by Spark; its place in the recipe (or its fold number)
  becomes the ``rank`` column used by the vote.
* Broken input fails the read (``FAILFAST``) instead of giving null rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.functions import fixed
from dialframe.session import file_system, ship_package
from dialframe.sources.commit import incomplete, write_if_absent, write_parts_if_absent
from dialframe.sources.json_array import parse_records, read_array_records, read_line_records

EXAMPLE_READ_SCHEMA = (
    "id string, input struct<conversation: array<struct<speaker:int, utterance:string, utterance_id:variant>>, "
    "reference_id: array<string>, category: string, inference_1: string, inference_2: string, "
    "inference_3: string>, output string")

PREDICTION_READ_SCHEMA = "id string, output string"


def _ids_from_variant(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.variant_get(v, "$", "array<string>")).otherwise(
        F.array(F.variant_get(v, "$", "string")))


def _ids_to_variant(ids: Column) -> Column:
    """One id -> the bare string, several -> a list (as the refined files store them)."""
    return F.when(F.size(ids) == 1, F.variant_get(F.to_variant_object(ids), "$[0]", "variant")).otherwise(
        F.to_variant_object(ids))


def read_examples(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True,
                  glob: str = "*.json") -> DataFrame:
    """Every ``*.json`` (not recursive) under ``path``: one row per example, split from the file name.

    ``multi_line=True`` reads files that each hold one JSON array; ``False`` reads
    JSON Lines, e.g. the refined output.  Both are read in byte ranges.

    Columns: id, split, conversation (``array<struct<speaker, utterance,
    utterance_id: array<string>>>``), reference_id, category, inference_1..3, output, position.
    """
    if multi_line:
        raw = parse_records(read_array_records(spark, path, glob), EXAMPLE_READ_SCHEMA)
        place = F.col("position")
    else:
        raw = parse_records(read_line_records(spark, path, glob).withColumnRenamed("position", "line"),
                            f"{EXAMPLE_READ_SCHEMA}, position long", keep=("file", "line"))
        place = F.coalesce("position", "line")  # refined output names the place that the example came from
    conv = F.transform("input.conversation", lambda u: F.struct(
        u["speaker"].alias("speaker"), u["utterance"].alias("utterance"),
        _ids_from_variant(u["utterance_id"]).alias("utterance_id")))
    # Files written by this library sit in split=<name> directories; the original layout names
    # the split by the file stem.
    file = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract("file", r"/split=([^/]*)/[^/]*$", 1)
    split = F.when(folder != "", F.url_decode(F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))))).otherwise(
        F.regexp_extract(file, r"([^/]*)\.json$", 1))
    return raw.select(
        "id", split.alias("split"),
        conv.alias("conversation"), F.col("input.reference_id").alias("reference_id"),
        F.col("input.category").alias("category"), F.col("input.inference_1").alias("inference_1"),
        F.col("input.inference_2").alias("inference_2"), F.col("input.inference_3").alias("inference_3"),
        F.coalesce(F.col("output"), F.lit("")).alias("output"), place.alias("position"))


def ingest_examples(spark: SparkSession, src: str | Sequence[str], dest: str, multi_line: bool = True) -> None:
    """Read the JSON files once and write Parquet partitioned by split (splittable, prunable)."""
    read_examples(spark, src, multi_line).write.mode("overwrite").partitionBy("split").parquet(dest)


def read_ingested(spark: SparkSession, path: str, splits: Sequence[str] | None = None) -> DataFrame:
    """Read ingested examples; a split filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("split").isin(*splits)) if splits else df


def to_example_json_columns(df: DataFrame) -> DataFrame:
    """Back to the file layout: ``id``, ``input`` struct, ``output`` (ids unwrapped when single), ``position`` if known."""
    conv = F.transform("conversation", lambda u: F.struct(
        u["speaker"].alias("speaker"), u["utterance"].alias("utterance"),
        _ids_to_variant(u["utterance_id"]).alias("utterance_id")))
    inp = F.struct(conv.alias("conversation"), F.col("reference_id").alias("reference_id"),
                   F.col("category").alias("category"), F.col("inference_1").alias("inference_1"),
                   F.col("inference_2").alias("inference_2"), F.col("inference_3").alias("inference_3"))
    return df.select("id", inp.alias("input"), "output", "split", *[c for c in ("position",) if c in df.columns])


def write_examples_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines, one directory per split, non-ASCII kept as is (UTF-8)."""
    to_example_json_columns(df).write.mode(mode).partitionBy("split").json(path)


def write_examples_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per split, every file in it one JSON array (``read_examples(..., glob="*.txt")``).

    A task numbers the lines of each split as they pass, brackets and commas among
    them, and sorts them by split and number into its files: no row leaves its task.
    """
    ship_package(df.sparkSession)
    rows = to_example_json_columns(df)
    lines = rows.select("split", F.to_json(F.struct(*[c for c in rows.columns if c != "split"])).alias("value"))

    def bracket(batches: Iterator) -> Iterator:
        import pyarrow as pa
        names, seen = ["split", "number", "value"], {}
        for batch in batches:
            splits, numbers, values = batch.column("split").to_pylist(), [], []
            for s, v in zip(splits, batch.column("value").to_pylist()):
                numbers.append(seen.get(s, 0))
                values.append(("," if numbers[-1] else "[") + v)
                seen[s] = numbers[-1] + 1
            yield pa.RecordBatch.from_arrays([batch.column("split"), pa.array(numbers, pa.int64()),
                                              pa.array(values, pa.string())], names)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()),
                                          pa.array(["]"] * len(seen), pa.string())], names)

    out = lines.mapInArrow(bracket, "split string, number long, value string").sortWithinPartitions("split", "number")
    out.select("value", "split").write.mode(mode).partitionBy("split").text(path)


def write_lengths_csv(df: DataFrame, path: str, id_col: str = "id", value: str = "total_utterance_length",
                      mode: str = "overwrite") -> None:
    """``id,total_utterance_length`` with a header."""
    df.select(id_col, value).write.mode(mode).option("header", True).csv(path)


def _holds_array(spark: SparkSession, path: str) -> bool:
    """Whether a prediction set is one JSON array (else JSON Lines); raises where there is none.

    A folder is judged by its first data file that is not empty.
    """
    fs, hp = file_system(spark, path)
    if not fs.exists(hp):
        raise FileNotFoundError(f"File not found: {path}")
    found = [hp]
    if fs.getFileStatus(hp).isDirectory():
        found = sorted((x.getPath() for x in fs.listStatus(hp) if x.isFile() and x.getLen() > 0
                        and x.getPath().getName()[0] not in "_."), key=lambda p: p.toString())
    for p in found[:1]:
        stream = fs.open(p)
        try:
            byte = stream.read()
            while byte in (0x20, 0x09, 0x0A, 0x0D, 0xEF, 0xBB, 0xBF):  # white space, byte order mark
                byte = stream.read()
            return byte == ord("[")
        finally:
            stream.close()
    return False


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, output) of one prediction set, in either layout."""
    array = _holds_array(spark, path)
    return (spark.read.schema(PREDICTION_READ_SCHEMA).option("multiLine", array).option("mode", "FAILFAST").json(path)
            .select("id", "output"))


def prediction_file_names(names: Sequence[str]) -> list[str]:
    """Add ``.json`` where missing (recipe entries are given without it)."""
    return [n if n.endswith(".json") else f"{n}.json" for n in names]


def _ranked(spark: SparkSession, paths: Sequence[str], models: Sequence[str]) -> DataFrame:
    """The sets stacked, each with its 1-based place and its name (a union of as many scans as the caller lists)."""
    parts = [read_predictions(spark, p).select("id", "output", F.lit(i).alias("rank"), F.lit(m).alias("model"))
             for i, (p, m) in enumerate(zip(paths, models), start=1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_prediction_sets(spark: SparkSession, base_dir: str, names: Sequence[str]) -> DataFrame:
    """Prediction sets in recipe order: (id, output, rank, model) with rank 1 = first name.

    Missing files raise ``FileNotFoundError`` before any job runs.
    """
    files = prediction_file_names(names)
    return _ranked(spark, [os.path.join(base_dir, f) for f in files], [f[:-len(".json")] for f in files])


def fold_prediction_paths(output: str, k: int) -> list[str]:
    """``<output without .json>_fold_<i>.json`` for i = 1..k."""
    stem = output.split(".json")[0]
    return [f"{stem}_{fold_name(i)}.json" for i in range(1, k + 1)]


def read_fold_predictions(spark: SparkSession, output: str, k: int) -> DataFrame:
    """The k fold prediction sets of one model: (id, output, rank = fold number, model = ``fold_<i>``)."""
    return _ranked(spark, fold_prediction_paths(output, k), [fold_name(i) for i in range(1, k + 1)])


def fold_name(fold: int) -> str:
    """``fold_<k>`` (1-based), the name of a fold's model and prediction set."""
    return f"fold_{fold}"


def prediction_set_name(variant: str, model_id: str, method: str, lr: str, refined: bool) -> str:
    """``[Refined_]<DatasetName>-<model basename>-<method>_<lr>`` (the recipe's file naming)."""
    dataset = dict(fixed.VARIANT_DATASET_NAMES)[variant]
    base = model_id.rstrip("/").split("/")[-1]
    return f"{fixed.REFINED_PREFIX if refined else ''}{dataset}-{base}-{method}_{lr}"


def recipe_names() -> list[str]:
    """The prediction-set names of the ensemble recipe, in vote order."""
    return [prediction_set_name(v, m, method, lr, refined) for _, v, refined, m, method, lr in fixed.RECIPE]


def recipe_frame(spark: SparkSession) -> DataFrame:
    """The ensemble recipe as a small dimension table with the derived prediction-set names."""
    rows = [(r, v, ref, m, meth, lr, prediction_set_name(v, m, meth, lr, ref)) for r, v, ref, m, meth, lr in fixed.RECIPE]
    return spark.createDataFrame(rows, "rank int, variant string, refined boolean, model string, method string, "
                                       "lr string, name string")


def unfinished_folds(spark: SparkSession, output: str, k: int) -> list[int]:
    """The folds of 1..k whose prediction set is not complete (resume after an interruption)."""
    return incomplete(spark, fold_prediction_paths(output, k))


def write_prediction_sets(preds: DataFrame, base_dir: str, names: Sequence[str], rank: str = "rank",
                          id_col: str = "id", label: str = "output") -> list[str]:
    """Write the sets of a recipe in one pass: ``rank`` 1 goes to the first name, and so on; complete sets stay."""
    paths = [os.path.join(base_dir, f) for f in prediction_file_names(names)]
    rows = preds.select(F.col(rank).cast("int").alias("rank"), F.col(id_col).alias("id"), F.col(label).alias("output"))
    write_parts_if_absent(rows, "rank", dict(enumerate(paths, start=1)))
    return paths


def write_fold_predictions(preds: DataFrame, output: str, k: int, fold: str = "fold",
                           id_col: str = "id", label: str = "output") -> list[str]:
    """Write the prediction sets of the unfinished folds to ``<output>_fold_<i>.json`` in one pass over ``preds``.

    Sets that are complete stay.  Each new set is staged and published on its own, so
    an interruption leaves whole sets only.
    """
    paths = fold_prediction_paths(output, k)
    rows = preds.select(F.col(fold).cast("int").alias("fold"), id_col, label)
    write_parts_if_absent(rows, "fold", dict(enumerate(paths, start=1)))
    return paths


def id_sequence(id_col: Column | str) -> Column:
    """The trailing number of an example id (``...-train-000042`` -> 42): the file order of the
    examples of a split, usable as the numeric order key of the row index and K-fold."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("bigint")
