"""Column expressions for utterance cleaning and token normalisation.

All expressions are built-in Spark functions, so they stay inside whole-stage
codegen.  Java regexes are ASCII by default; ``(?U)`` switches ``\\w``, ``\\s``
and ``\\b`` to Unicode so they agree with a Unicode regex engine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialframe.functions import fixed

# Python's str.strip() also strips U+001C..U+001F, Java's Unicode \s does not.
_STRIP_CLASS = r"[\s\x{1C}-\x{1F}]"


@dataclass(frozen=True)
class CleanConfig:
    """Parameters of the cleaning chain; defaults are the dataset's fixed values."""

    null_text: str | None = fixed.NULL_TEXT
    run_char: str = fixed.AFFIRMATIVE_RUN_CHAR
    run_word: str = fixed.AFFIRMATIVE_WORD
    special_characters: str = fixed.SPECIAL_CHARACTERS
    greeting_stems: tuple[str, ...] = fixed.GREETING_STEMS
    aliases: tuple[tuple[str, str], ...] = field(default_factory=lambda: fixed.NAME_ALIASES)
    jamo_class: str = fixed.JAMO_CLASS
    script_class: str = fixed.HANGUL_SYLLABLE_CLASS


DEFAULT_CLEAN = CleanConfig()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_replace(t: Column, old: str, new: str) -> Column:
    return F.replace(t, F.lit(old), F.lit(new))


def strip_unicode(t: Column | str) -> Column:
    """Strip Unicode whitespace at both ends (``F.trim`` strips only spaces)."""
    return F.regexp_replace(_col(t), rf"(?U)\A{_STRIP_CLASS}+|{_STRIP_CLASS}+\z", "")


def clean_utterance(text: Column | str, cfg: CleanConfig = DEFAULT_CLEAN) -> Column:
    """The utterance cleaning chain, in its fixed order.

    1. to text (missing -> ``cfg.null_text``); 2. newline -> space, one pass of
    double space -> single space; 3. a stand-alone run of two or more ``ㅇ`` ->
    ``응``; 4. four or more dots -> ``...``, two or more ``?`` -> ``??``;
    5. delete the special characters; 6. delete words that start with a greeting
    stem; 7. aliases; 8. delete compatibility jamo anywhere; 9. blank out text that
    has no Hangul syllable but has a character that is neither word nor space;
    10. strip.
    """
    t = _col(text).cast("string")
    if cfg.null_text is not None:
        t = F.coalesce(t, F.lit(cfg.null_text))
    t = _lit_replace(t, "\n", " ")
    t = _lit_replace(t, "  ", " ")          # one non-overlapping pass: 4 spaces -> 2
    run = F.lit(f"(?U)(?<=^|\\s){cfg.run_char}{{2,}}(?=$|\\s)")
    t = F.regexp_replace(t, run, F.lit(cfg.run_word))
    t = F.regexp_replace(t, r"\.{4,}", "...")
    t = F.regexp_replace(t, r"\?{2,}", "??")
    t = F.translate(t, cfg.special_characters, "")
    for stem in cfg.greeting_stems:
        t = F.regexp_replace(t, rf"(?U)\b{stem}\w*", "")
    for old, new in cfg.aliases:
        t = _lit_replace(t, old, new)
    t = F.regexp_replace(t, f"{cfg.jamo_class}+", "")
    # One regex, so the chain above is referenced once (a CASE would copy it three times).
    t = F.regexp_replace(t, rf"(?Us)\A(?!.*{cfg.script_class})(?=.*[^\w\s]).*\z", "")
    return strip_unicode(t)


def squeeze_jamo_runs(token: Column | str, letters: tuple[str, ...] = fixed.SQUEEZED_JAMO) -> Column:
    """Every run (one or more) of each listed jamo becomes exactly two of it."""
    t = _col(token)
    for ch in letters:
        t = F.regexp_replace(t, f"{ch}+", ch * 2)
    return t


def split_on_space(text: Column | str) -> Column:
    """Split on a single space; empty tokens are kept, as with ``str.split(' ')``."""
    return F.split(_col(text), " ", -1)


def code_point_length(text: Column | str) -> Column:
    """Length in code points (``F.length`` counts code points, not UTF-16 units)."""
    return F.length(_col(text)).cast("bigint")
