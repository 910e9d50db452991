"""dialframe: dialogue-dataset preparation, statistics and voting as Spark jobs.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function; see README.md for the operator map.  The names below are the ones a
job usually needs.
"""

__version__ = "0.1.0"

from dialframe.functions.hangul import has_final_consonant  # noqa: E402
from dialframe.functions.text import CleanConfig, clean_utterance, squeeze_jamo_runs, strip_unicode  # noqa: E402
from dialframe.operators.encode import (ChatTemplate, code_points, encode_examples, pad_batches,  # noqa: E402
                                        pandas_encoder)
from dialframe.operators.folds import fold_roles, kfold, with_global_index  # noqa: E402
from dialframe.operators.prompts import VARIANTS, build_prompts, to_messages  # noqa: E402
from dialframe.operators.score import predict_from_scores, score_batches, source_only  # noqa: E402
from dialframe.operators.stats import (distribution, fixed_key_distribution, histogram,  # noqa: E402
                                       length_summary, token_counts, top_tokens, with_combined_split)
from dialframe.operators.turns import (clean_and_drop_empty, example_lengths, merge_examples,  # noqa: E402
                                       merge_turns, nest_turns, refine_examples)
from dialframe.operators.vote import (accuracy, attach_predictions, check_prediction_sets,  # noqa: E402
                                      hard_vote, validate_prediction_sets)
from dialframe.sources.jsonio import (read_examples, read_prediction_sets, write_examples_json,  # noqa: E402
                                      write_lengths_csv)

__all__ = [
    "CleanConfig", "clean_utterance", "squeeze_jamo_runs", "strip_unicode", "has_final_consonant",
    "clean_and_drop_empty", "merge_turns", "nest_turns", "merge_examples", "refine_examples", "example_lengths",
    "distribution", "fixed_key_distribution", "histogram", "length_summary", "token_counts", "top_tokens",
    "with_combined_split", "VARIANTS", "build_prompts", "to_messages", "ChatTemplate", "code_points",
    "encode_examples", "pad_batches", "pandas_encoder", "with_global_index", "kfold", "fold_roles",
    "predict_from_scores", "score_batches", "source_only", "hard_vote", "attach_predictions",
    "validate_prediction_sets", "check_prediction_sets", "accuracy", "read_examples", "read_prediction_sets",
    "write_examples_json", "write_lengths_csv",
]
