"""Command line: the dataset jobs as Spark jobs.

    python -m dialframe ingest  SRC OUT                 example files once to Parquet, by split
    python -m dialframe refine  SRC OUT                 clean + merge every example in SRC
    python -m dialframe eda     SRC OUT                 statistics tables (CSV) per split
    python -m dialframe prompts SRC OUT --variant v1    prompts + encoded examples (Parquet)
    python -m dialframe score   ENC OUT --scorer m:f    score encoded examples to a prediction set (or one per fold)
    python -m dialframe pad     ENC OUT --batch-size N  padded batches of encoded examples (Parquet)
    python -m dialframe vote    --submission F --output OUT (--k-folds K | --predictions-dir D (NAME ... | --recipe))

SRC holds ``*.json`` files with one JSON array of examples each (split = file stem);
``--json-lines`` reads refined output (JSON Lines), so statistics of raw and refined data
come from the same command.  Both are read in byte ranges.  ``--ingested`` reads the Parquet
of ``ingest``, which several commands can share.
ENC is the Parquet that ``prompts`` writes; ``--split`` and ``--variant`` choose its rows.  A scorer
is named ``module:function``: the function builds it (with ``--k-folds`` it is given the fold).
Every command runs on the session's master; outputs are directories written by Spark.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dialframe.functions import fixed


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("dialframe").getOrCreate()
    from dialframe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return spark


def _examples(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The examples of SRC in whichever layout the flags name."""
    from dialframe.sources.jsonio import read_examples, read_ingested
    if a.ingested:
        return read_ingested(spark, a.src)
    return read_examples(spark, a.src, multi_line=not a.json_lines)


def cmd_ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    from dialframe.sources.jsonio import ingest_examples
    ingest_examples(spark, a.src, a.out, multi_line=not a.json_lines)


def cmd_refine(spark: SparkSession, a: argparse.Namespace) -> None:
    from dialframe.operators.turns import refine_examples
    from dialframe.sources.jsonio import write_examples_json
    write_examples_json(refine_examples(_examples(spark, a)), a.out)


def cmd_eda(spark: SparkSession, a: argparse.Namespace) -> None:
    from dialframe.operators import stats
    from dialframe.operators.turns import example_lengths, flatten_conversation
    from dialframe.session import materialize, release_materialized

    ex = _examples(spark, a)
    if not a.ingested:
        ex = materialize(ex, "eda-examples")  # nine tables follow: parse the JSON once
    source = ex
    ex = stats.with_combined_split(ex)
    lens = example_lengths(ex)
    utt = flatten_conversation(ex, keep=("split",)).select("split", F.col("utterance").cast("string").alias("text"))
    tokens = stats.token_counts(utt, "text", "split")
    tables = {
        "split_sizes": stats.split_sizes(ex),
        "category_distribution": stats.distribution(ex, "category", "split"),
        "output_distribution": stats.fixed_key_distribution(ex, "output", fixed.ANSWER_KEYS, "split"),
        "turn_summary": stats.length_summary(lens, "n_turns", "split"),
        "length_summary": stats.length_summary(lens, "total_utterance_length", "split"),
        "turn_histogram": stats.histogram(lens, "n_turns", fixed.TURN_HISTOGRAM_STEP, "split"),
        "length_histogram": stats.histogram(lens, "total_utterance_length", fixed.CHAR_HISTOGRAM_STEP, "split"),
        "total_utterance_lengths": lens.select("split", "id", "total_utterance_length"),
        "top_tokens": stats.top_tokens(tokens, fixed.TOP_TOKENS, "split"),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(os.path.join(a.out, name))
    if not a.ingested:
        release_materialized(source)


def _system_texts(values: Sequence[str]) -> dict[str, str]:
    """``variant=text`` arguments as a mapping."""
    pairs = [v.split("=", 1) for v in values]
    if any(len(p) != 2 for p in pairs):
        raise ValueError("--system-text takes variant=text")
    return dict(pairs)


def cmd_prompts(spark: SparkSession, a: argparse.Namespace) -> None:
    from dialframe.operators.encode import encode_examples, train_folds
    from dialframe.operators.prompts import build_prompts, variant
    from dialframe.session import materialize, release_materialized

    examples = _examples(spark, a)
    places = [c for c in ("position",) if c in examples.columns]
    prompts = build_prompts(examples, a.variant, keep=("id", "split", *places), eos_token=a.eos,
                            ids_are_arrays=True, system_text=_system_texts(a.system_text),
                            particle_mode=a.particle_mode)
    by = ["split", "variant"]
    filtered = a.mode == "train" and a.max_source_len is not None
    counts = Observation("length filter") if filtered else None
    enc = encode_examples(prompts, keep=("id", "system", "user", *by, *places), mode=a.mode,
                          max_source_len=a.max_source_len, observation=counts)
    source = None
    if a.k_folds > 1:
        # Every source is encoded once: the rows that the length filter left are written, then folded.
        source = enc = materialize(enc, "encoded")
        enc = enc.join(train_folds(enc, a.k_folds), ["id", "split", "variant"], "left")
        by.append("fold")
    enc.write.mode("overwrite").partitionBy(*by).parquet(a.out)
    if source is not None:
        release_materialized(source)
    if counts is not None:
        found = counts.get
        print(f"length filter: {found['n_dropped']} of {found['n_dropped'] + found['n_kept']} examples dropped")
        for v in dict.fromkeys(variant(x).name for x in a.variant):
            print(f"  {v}: {found[f'n_dropped_{v}']} dropped, {found[f'n_kept_{v}']} kept")


def _encoded(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Rows of the encoded examples that the flags choose."""
    enc = spark.read.parquet(a.src)
    for name in ("split", "variant"):
        value = getattr(a, name)
        if value is not None:
            enc = enc.where(F.col(name) == value)
    return enc


def _named(reference: str):
    """The object that ``module:name`` names."""
    import importlib
    module, _, name = reference.partition(":")
    if not name:
        raise ValueError(f"--scorer takes module:function, got {reference!r}")
    return getattr(importlib.import_module(module), name)


def cmd_score(spark: SparkSession, a: argparse.Namespace) -> None:
    from dialframe.operators.score import predict_from_scores, score_batches, source_only
    from dialframe.plans.ensemble import SCORES, predict_folds
    from dialframe.sources.jsonio import write_if_absent

    rows, factory = source_only(_encoded(spark, a), ["id"]), _named(a.scorer)
    if a.k_folds > 1:
        predict_folds(rows, factory, a.out, a.k_folds, batch_rows=a.batch_rows)
        return
    scored = score_batches(rows, factory, ["id"], SCORES, batch_rows=a.batch_rows)
    write_if_absent(predict_from_scores(scored, SCORES, ["id"]).select("id", "output"), a.out)


def cmd_pad(spark: SparkSession, a: argparse.Namespace) -> None:
    from dialframe.operators.encode import pad_batches

    enc = _encoded(spark, a)
    order = [c for c in ("split", "variant", "position", "id") if c in enc.columns]
    pad_batches(enc, order, a.batch_size, a.pad_id, a.mask_by).write.mode("overwrite").parquet(a.out)


def cmd_vote(spark: SparkSession, a: argparse.Namespace) -> None:
    from dialframe.plans.ensemble import ensemble
    from dialframe.sources.jsonio import read_predictions, recipe_names

    names = recipe_names() if a.recipe else a.names
    res = ensemble(spark, read_predictions(spark, a.submission), k_folds=a.k_folds, output=a.fold_output, base_dir=a.predictions_dir,
                   names=names)
    res.write.mode("overwrite").json(a.output)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dialframe", description=__doc__,
                                formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="cmd", required=True)
    source = argparse.ArgumentParser(add_help=False)
    source.add_argument("src")
    source.add_argument("out")
    layout = source.add_mutually_exclusive_group()
    layout.add_argument("--json-lines", action="store_true", help="SRC holds JSON Lines (e.g. refined output)")
    layout.add_argument("--ingested", action="store_true", help="SRC holds the Parquet that ingest wrote")
    sub.add_parser("ingest", parents=[source], help="example files to Parquet, partitioned by split")
    sub.add_parser("refine", parents=[source], help="clean and merge utterances of every example")
    sub.add_parser("eda", parents=[source], help="statistics tables per split (train+dev included)")
    pr = sub.add_parser("prompts", parents=[source], help="prompts and encoded examples")
    pr.add_argument("--variant", nargs="+", default=["v1"], help="v1..v5 or the dataset names of the recipe")
    pr.add_argument("--mode", choices=["train", "eval"], default="eval")
    pr.add_argument("--max-source-len", type=int, default=None)
    pr.add_argument("--eos", default="</s>")
    pr.add_argument("--system-text", action="append", default=[], metavar="VARIANT=TEXT")
    pr.add_argument("--particle-mode", choices=["reference", "append"], default="reference")
    pr.add_argument("--k-folds", type=int, default=1, help="fold the train rows (1-based, contiguous, file order, per variant)")
    chosen = argparse.ArgumentParser(add_help=False)
    chosen.add_argument("src")
    chosen.add_argument("out")
    chosen.add_argument("--split", default=None)
    chosen.add_argument("--variant", default=None)
    sc = sub.add_parser("score", parents=[chosen], help="score encoded examples to prediction sets")
    sc.add_argument("--scorer", required=True, metavar="MODULE:FUNCTION")
    sc.add_argument("--k-folds", type=int, default=1, help="a model per fold; finished folds are not scored again")
    sc.add_argument("--batch-rows", type=int, default=256)
    pa = sub.add_parser("pad", parents=[chosen], help="padded batches in file order")
    pa.add_argument("--batch-size", type=int, required=True)
    pa.add_argument("--pad-id", type=int, default=0)
    pa.add_argument("--mask-by", choices=["value", "length"], default="value")
    v = sub.add_parser("vote", help="hard vote over fold predictions or an ordered list of prediction sets")
    v.add_argument("--submission", required=True)
    v.add_argument("--output", required=True)
    v.add_argument("--k-folds", type=int, default=1)
    v.add_argument("--fold-output", default=None, help="path whose _fold_<k>.json files are voted")
    v.add_argument("--predictions-dir", default=None)
    v.add_argument("--recipe", action="store_true", help="vote the sets of the recipe, in its order")
    v.add_argument("names", nargs="*", help="prediction sets in vote order (earliest wins ties)")
    return p


COMMANDS = {"ingest": cmd_ingest, "refine": cmd_refine, "eda": cmd_eda, "prompts": cmd_prompts, "score": cmd_score,
            "pad": cmd_pad, "vote": cmd_vote}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = build_parser().parse_args(argv)
    COMMANDS[a.cmd](spark or _session(), a)


if __name__ == "__main__":
    main()
