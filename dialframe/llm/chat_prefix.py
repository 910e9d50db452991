"""Chat formatting by prefix-target expansion, DataFrame functions only.

Every assistant turn becomes one example: all turns before it are context, and
only its reply is trainable.  Examples of one conversation share their context,
so the stored form keeps each formatted turn once, with character offsets into
the conversation's stream; an example is a pair (context length, target span).
That is linear in the input where written-out examples grow with the square of
the number of turns; :func:`expand_examples` writes them out.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Inside role and text
a backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can
occur in content; a line feed inside a role becomes backslash + line feed.
Dropping each escaping backslash gives the content back.

Defined results: a null role or text is empty; a null turn sorts first and equal
turn numbers are ordered by role, then text; repeated rows are turns of their
own; a null conversation id is a conversation; a conversation without assistant
turns has no example but keeps its turns; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialframe.llm.common import pick

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Reversible escape of control strings."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: each backslash goes, the character after it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per turn: conv_id, ordinal, piece, piece_start.

    ``piece`` is the formatted turn and ``piece_start`` its character offset in
    the conversation's stream (the pieces joined in ordinal order).
    """
    t = pick(df, conv_id=conv_id, turn=turn, role=role, text=text)
    t = t.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text"))
    header = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (t.withColumn("piece", F.concat(header, escape(F.col("text")), F.lit(CLOSE + "\n")))
            .select("conv_id",
                    F.row_number().over(order).cast("long").alias("_n"),
                    "piece",
                    F.sum(F.length("piece").cast("long")).over(
                        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_end"))
            .select("conv_id", (F.col("_n") - 1).alias("ordinal"), "piece",
                    (F.col("_end") - F.length("piece")).alias("piece_start")))


def parse_piece(piece: Column) -> tuple[Column, Column, Column]:
    """(role, text, header length) read back from a formatted turn."""
    head = F.regexp_extract(piece, r"(?s)^<\|im_start\|>([^\\\n]*(?:\\.[^\\\n]*)*)\n", 1)
    header_chars = F.lit(len(OPEN) + 1) + F.length(head)
    body = F.substring(piece, header_chars + 1, F.length(piece) - header_chars - F.lit(len(CLOSE) + 1))
    return unescape(head), unescape(body), header_chars


def prefix_targets(stream: DataFrame) -> DataFrame:
    """The stream's turns with the example of each assistant turn.

    Adds role, text, context_turns, context_chars (everything before the reply,
    its header included), target_start and target_chars (the reply, the only
    trainable span, as offsets into the stream).  The last four are null where
    the turn is not an assistant's and so makes no example.
    """
    role, text, header = parse_piece(F.col("piece"))
    is_target = F.col("role") == "assistant"
    return (stream.withColumns({"role": role, "text": text, "_header": header.cast("long")})
            .withColumns({
                "context_turns": F.when(is_target, F.col("ordinal")),
                "context_chars": F.when(is_target, F.col("piece_start") + F.col("_header")),
                "target_start": F.when(is_target, F.col("piece_start") + F.col("_header")),
                "target_chars": F.when(is_target, F.length("piece") - F.col("_header") - len(CLOSE) - 1)})
            .drop("_header"))


def write_out(examples: DataFrame) -> DataFrame:
    """The stream's turns with the written-out example of each assistant turn: context, target and mask.

    ``mask`` is the trainable span of context and target joined.  All three are
    null where the turn makes no example.  Grows with the square of a
    conversation's turns by definition.
    """
    before = Window.partitionBy("conv_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    is_example = F.col("target_start").isNotNull()
    header = (F.col("target_start") - F.col("piece_start")).cast("int")
    return (examples.withColumn("_before", F.collect_list("piece").over(before))
            .withColumns({
                "context": F.when(is_example, F.concat(F.concat_ws("", "_before"),
                                                       F.substring(F.col("piece"), F.lit(1), header))),
                "target": F.when(is_example, F.substring(F.col("piece"), header + 1,
                                                         F.col("target_chars").cast("int")))})
            .withColumn("mask", F.when(is_example, F.struct(
                F.length("context").alias("start"), (F.length("context") + F.length("target")).alias("end"))))
            .drop("_before"))


def expand_examples(examples: DataFrame) -> DataFrame:
    """Written-out examples, one row per assistant turn: conv_id, context_turns, context, target."""
    return (write_out(examples).where(F.col("target_start").isNotNull())
            .select("conv_id", "context_turns", "context", "target"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what the formatted output says: turns, trainable text and sizes.

    Trainable text and ``expanded_chars`` are those of the written-out examples.
    """
    examples = write_out(examples).withColumn("example", F.concat("context", "target"))
    reply = unescape(F.substring(F.col("example"), F.col("mask.start") + 1, F.col("mask.end") - F.col("mask.start")))
    turns = F.array_sort(F.collect_list(F.struct("ordinal", "role", "text", reply.alias("reply"))))
    grouped = examples.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), turns.alias("turns"),
        F.sum(F.length("piece").cast("long")).alias("formatted_chars"),
        F.count("example").alias("n_examples"),
        F.coalesce(F.sum(F.length("example").cast("long")), F.lit(0)).alias("expanded_chars"))
    all_turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"],
                                                                        F.lit("\n"))))
    loss = F.concat_ws("", F.transform("turns", lambda t: t["reply"]))
    return grouped.select(
        "conv_id", "n_turns", F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_examples", "expanded_chars")
