"""Prompt and supervised-target construction in five variants (one builder, variant rows as data).

An *example* row holds ``conversation`` (array of ``struct<speaker, utterance,
utterance_id>``), ``reference_id`` (array<string>), ``category``,
``inference_1..3`` and ``output``.  The variants differ only in wording, the
subject that names the category, the particle pair, the speaker label of the
conversation block and the block order, so they are rows of attributes and the
prompt is one expression over them.  Building several variants expands every
example with a generator (``inline``) - no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialframe.functions import fixed
from dialframe.functions.hangul import has_final_consonant


@dataclass(frozen=True)
class Variant:
    name: str
    subject: str                # "category", "term" or "definition"
    lead: str
    particles: tuple[str, str]  # (after a final consonant, otherwise)
    tail: str
    conversation_label_sep: str = ""   # between the speaker label and the number, conversation block only
    instruction_first: bool = False
    system_text: str | None = fixed.DEFAULT_SYSTEM_TEXT


VARIANTS: dict[str, Variant] = {
    "v1": Variant("v1", "category", fixed.QUESTION_LEAD, fixed.PARTICLES_DIRECTION, fixed.QUESTION_TAIL),
    "v2": Variant("v2", "term", fixed.QUESTION_LEAD, fixed.PARTICLES_DIRECTION, fixed.QUESTION_TAIL),
    "v3": Variant("v3", "definition", fixed.DEFINITION_QUESTION_LEAD, fixed.PARTICLES_OBJECT,
                  fixed.DEFINITION_QUESTION_TAIL),
    "v4": Variant("v4", "definition", fixed.INSTRUCTION_LEAD, fixed.PARTICLES_OBJECT, fixed.INSTRUCTION_TAIL,
                  instruction_first=True),
    # The long system text of this variant is caller configuration (pass ``system_text``).
    "v5": Variant("v5", "term", fixed.QUESTION_LEAD, fixed.PARTICLES_DIRECTION, fixed.QUESTION_TAIL_SYSTEM,
                  conversation_label_sep=" ", system_text=None),
}


def variant(name: str) -> Variant:
    """Variant by name; also accepts the dataset names of the original recipe."""
    by_dataset = {ds: v for v, ds in fixed.VARIANT_DATASET_NAMES}
    key = by_dataset.get(name, name)
    if key not in VARIANTS:
        raise ValueError(f"unknown prompt variant {name!r}; expected one of {sorted(VARIANTS)} "
                         f"or {sorted(by_dataset)}")
    return VARIANTS[key]


def _lookup(category: Column, idx: int) -> Column:
    """Official term (idx 1) or definition (idx 2) of a category; an unknown category raises."""
    m = F.create_map(*[x for row in fixed.CATEGORIES for x in (F.lit(row[0]), F.lit(row[idx]))])
    v = F.element_at(m, category)
    return F.when(v.isNull(), F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(category, F.lit("null"))))
                  ).otherwise(v)


def category_term(category: Column) -> Column:
    return _lookup(category, 1)


def category_definition(category: Column) -> Column:
    return _lookup(category, 2)


def _as_text(c: Column) -> Column:
    # str(x) of the original: a missing value prints as None.
    return F.coalesce(c.cast("string"), F.lit(fixed.NULL_TEXT))


def _lines(conv: Column, label_sep: Column | str) -> Column:
    sep = F.lit(label_sep) if isinstance(label_sep, str) else label_sep
    kept = F.filter(conv, lambda u: F.length(_as_text(u["utterance"])) > 1)
    return F.transform(kept, lambda u: F.concat(F.lit(fixed.SPEAKER_LABEL), sep, u["speaker"].cast("string"),
                                                F.lit(": "), _as_text(u["utterance"])))


def conversation_block(conv: Column, label_sep: Column | str = "") -> Column:
    """``[Conversation]`` and one ``화자{n}: text`` line per utterance longer than one character."""
    return F.array_join(F.concat(F.array(F.lit(fixed.CONVERSATION_HEADER)), _lines(conv, label_sep)), "\n")


def reference_block(conv: Column, reference_ids: Column, ids_are_arrays: bool = False) -> Column:
    """``[Utterance References]`` and the reference utterances in conversation order.

    With array ids (refined data) only a single-id entry can match; a merged run
    never does, as with list membership in the original.
    """
    if ids_are_arrays:
        refs = F.filter(conv, lambda u: (F.size(u["utterance_id"]) == 1) & F.coalesce(
            F.array_contains(reference_ids, F.get(u["utterance_id"], 0)), F.lit(False)))
    else:
        refs = F.filter(conv, lambda u: F.coalesce(F.array_contains(reference_ids, u["utterance_id"]), F.lit(False)))
    return F.array_join(F.concat(F.array(F.lit(fixed.REFERENCE_HEADER)), _lines(refs, "")), "\n")


def question_text(category: Column, subject_kind: Column, lead: Column, with_final: Column, without_final: Column,
                  tail: Column, particle_mode: str = "reference") -> Column:
    """Lead + subject + particle + tail; the particle follows the subject's last syllable.

    ``particle_mode="reference"`` keeps the original quirk: without a final
    consonant the text before the particle is replaced by the bare particle.
    """
    raw = (F.when(subject_kind == "term", category_term(category))
           .when(subject_kind == "definition", category_definition(category))
           .otherwise(category))
    shown = F.when(subject_kind == "category", raw).otherwise(F.concat(F.lit("**"), raw, F.lit("**")))
    final = has_final_consonant(raw)
    head = F.concat(lead, shown)
    if particle_mode == "reference":
        q = F.when(final, F.concat(head, with_final)).otherwise(without_final)
    elif particle_mode == "append":
        q = F.concat(head, F.when(final, with_final).otherwise(without_final))
    else:
        raise ValueError(f"unknown particle mode {particle_mode!r}")
    return F.concat(q, tail)


def option_block(i1: Column, i2: Column, i3: Column) -> Column:
    opts = [F.concat(F.lit(f"{letter}. "), _as_text(c)) for letter, c in zip(fixed.OPTION_LETTERS, (i1, i2, i3))]
    return F.concat(F.lit(fixed.OPTION_HEADER + "\n"), F.concat_ws("\n", *opts))


def target_text(output: Column, i1: Column, i2: Column, i3: Column, eos_token: str) -> Column:
    """``A. option<eos>`` for the gold option, blank when there is no gold output."""
    t = F.lit("")
    for key, letter, c in zip(fixed.ANSWER_KEYS, fixed.OPTION_LETTERS, (i1, i2, i3)):
        t = F.when(output == key, F.concat(F.lit(f"{letter}. "), _as_text(c), F.lit(eos_token))).otherwise(t)
    return t


def gold_index(output: Column) -> Column:
    """Blank -> null, ``inference_n`` -> n - 1; any other value raises."""
    idx = None
    for i, key in enumerate(fixed.ANSWER_KEYS):
        idx = F.when(output == key, F.lit(i)) if idx is None else idx.when(output == key, F.lit(i))
    return (F.when(output == "", F.lit(None).cast("int"))
            .otherwise(F.coalesce(idx, F.raise_error(F.concat(F.lit("unknown output: "),
                                                              F.coalesce(output, F.lit("null")))).cast("int"))))


def index_to_output(idx: Column) -> Column:
    """0..2 -> ``inference_1..3``."""
    return F.concat(F.lit("inference_"), (idx + 1).cast("string"))


def _variant_rows(names: Sequence[str], system_text: Mapping[str, str]) -> Column:
    rows = []
    for n in names:
        v = variant(n)
        rows.append(F.struct(
            F.lit(v.name).alias("variant"), F.lit(v.subject).alias("_subject"), F.lit(v.lead).alias("_lead"),
            F.lit(v.particles[0]).alias("_pf"), F.lit(v.particles[1]).alias("_pn"), F.lit(v.tail).alias("_tail"),
            F.lit(v.conversation_label_sep).alias("_sep"), F.lit(v.instruction_first).alias("_instr_first"),
            F.lit(system_text.get(n, v.system_text)).cast("string").alias("system")))
    return F.array(*rows)


def build_prompts(examples: DataFrame, variants: Sequence[str] = ("v1",), keep: Sequence[str] = ("id",),
                  eos_token: str = "</s>", particle_mode: str = "reference", ids_are_arrays: bool = False,
                  system_text: str | Mapping[str, str] | None = None) -> DataFrame:
    """One row per example and variant: ``keep``, variant, system, user prompt, target, label.

    ``system_text`` maps variant names to a system text of the caller's; a plain
    string is that of every variant.  v5 has none of its own (its long system text
    is caller configuration): its ``system`` stays null without one, and
    :func:`to_messages` refuses such rows.
    """
    names = list(variants)
    texts = ({n: system_text for n in names} if isinstance(system_text, str)
             else {variant(k).name: v for k, v in (system_text or {}).items()})
    specs = [variant(n) for n in names]
    seps = sorted({v.conversation_label_sep for v in specs})
    # Blocks that do not depend on the variant are rendered once per example, before
    # the variant rows are generated.
    blocks = [conversation_block(F.col("conversation"), sep).alias(f"_conv{i}") for i, sep in enumerate(seps)]
    ex = examples.select(
        *keep, "category", "output", "inference_1", "inference_2", "inference_3", *blocks,
        reference_block(F.col("conversation"), F.col("reference_id"), ids_are_arrays).alias("_refs"),
        option_block(F.col("inference_1"), F.col("inference_2"), F.col("inference_3")).alias("_opts"))
    ex = ex.select("*", F.inline(_variant_rows([variant(n).name for n in names],
                                                {variant(k).name: v for k, v in texts.items()})))
    conv = None
    for i, sep in enumerate(seps):
        conv = (F.when(F.col("_sep") == sep, F.col(f"_conv{i}")) if conv is None
                else conv.when(F.col("_sep") == sep, F.col(f"_conv{i}")))
    q = question_text(F.col("category"), F.col("_subject"), F.col("_lead"), F.col("_pf"), F.col("_pn"),
                      F.col("_tail"), particle_mode)
    refs, opts = F.col("_refs"), F.col("_opts")
    user = F.when(F.col("_instr_first"), F.concat_ws("\n\n", q, conv, refs, opts)).otherwise(
        F.concat_ws("\n\n", conv, refs, q, opts))
    return ex.select(
        *keep, "variant", "system", user.alias("user"),
        target_text(F.col("output"), F.col("inference_1"), F.col("inference_2"), F.col("inference_3"),
                    eos_token).alias("target"),
        gold_index(F.col("output")).alias("label"))


def to_messages(system: Column, user: Column) -> Column:
    """``array<struct<role, content>>``: system then user; a missing system text raises."""
    given = F.coalesce(system, F.raise_error(F.lit("this variant has no system text: give one (system_text)")).cast(
        "string"))
    return F.array(F.struct(F.lit("system").alias("role"), given.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))
