"""Fixed values.

Everything in this module is a value that has to equal the original dataset
tooling's for the results to match: character sets, word stems, labels, prompt
wording, the ensemble recipe.  They are stated as plain text in their natural
order; the logic that uses them lives elsewhere.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: text cleaning
# ---------------------------------------------------------------------------
NULL_TEXT = "None"                       # text of a missing utterance
AFFIRMATIVE_RUN_CHAR = "ㅇ"              # two or more of these, standing alone ...
AFFIRMATIVE_WORD = "응"                  # ... become this word
SPECIAL_CHARACTERS = "~!><@_/-ᆢ:;()^"    # deleted one by one (the 9th is U+11A2)
GREETING_STEMS = ("안녕", "반갑습")       # a word starting with a stem is deleted
NAME_ALIASES = (("name1", "화자1"), ("name2", "화자2"))
JAMO_CLASS = "[ㄱ-ㅎㅏ-ㅣ]"               # compatibility jamo: consonants, then vowels
HANGUL_SYLLABLE_CLASS = "[가-힣]"

# ---------------------------------------------------------------------------
# FIXED VALUES: token statistics
# ---------------------------------------------------------------------------
SQUEEZED_JAMO = ("ㅋ", "ㅎ", "ㅇ", "ㄱ", "ㄴ", "ㄷ")   # a run of one becomes exactly two
TOP_TOKENS = 30
TURN_HISTOGRAM_STEP = 1
CHAR_HISTOGRAM_STEP = 50

# ---------------------------------------------------------------------------
# FIXED VALUES: labels
# ---------------------------------------------------------------------------
ANSWER_KEYS = ("inference_1", "inference_2", "inference_3")   # gold index 0, 1, 2; blank = none
OPTION_LETTERS = ("A", "B", "C")
IGNORE_INDEX = -100

# ---------------------------------------------------------------------------
# FIXED VALUES: inference categories (name, official term, definition)
# ---------------------------------------------------------------------------
CATEGORIES = (
    ("원인", "원인(cause)", "대화의 사건을 유발하는 사건"),
    ("후행사건", "후행 사건(subsequent event)", "대화 이후에 일어날 수 있는 사건"),
    ("전제", "전제 조건(prerequisite)", "대화의 사건을 가능하게 하는 상태 혹은 사건"),
    ("동기", "내적 동기(motivation)", "대화를 일으키는 '화자'의 감정이나 기본 욕구"),
    ("반응", "감정 반응(emotional reaction)", "대화 사건에 대해 '청자'가 보일 수 있는 감정 반응"),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt wording
# ---------------------------------------------------------------------------
CONVERSATION_HEADER = "[Conversation]"
REFERENCE_HEADER = "[Utterance References]"
OPTION_HEADER = "[Option]"
SPEAKER_LABEL = "화자"
DEFAULT_SYSTEM_TEXT = ("You are a helpful AI assistant. Please answer the user's questions kindly. "
                       "당신은 유능한 AI 어시스턴트 입니다. 사용자의 질문에 대해 친절하게 답변해주세요.")
QUESTION_LEAD = "[Question]\n위 대화의 특정 발화인 `Utterance References`에 대한 "
DEFINITION_QUESTION_LEAD = ("[Question]\n주어진 대화의 내용과 문맥으로 미루어 보았을 때, "
                            "특정 발화인 `Utterance References`에 대해 ")
INSTRUCTION_LEAD = ("[Instruction]\n주어진 대화의 내용과 문맥을 바탕으로, "
                    "특정 발화인 `Utterance References`에 대한 ")
PARTICLES_DIRECTION = ("으로", "로")      # after a final consonant / otherwise
PARTICLES_OBJECT = ("을", "를")
QUESTION_TAIL = " 올바른 지문은?"
QUESTION_TAIL_SYSTEM = " 올바른 추론문은?"
DEFINITION_QUESTION_TAIL = " 가장 잘 설명하는 문장은 무엇인가?"
INSTRUCTION_TAIL = " 가장 잘 설명하는 문장을 선택하라."

# ---------------------------------------------------------------------------
# FIXED VALUES: ensemble recipe, in vote order (rank 1 wins ties)
# (rank, prompt variant, refined input, base model, method, learning rate)
# ---------------------------------------------------------------------------
RECIPE = (
    (1, "v2", False, "POLAR-14B-v0.2", "QLoRA", "2e-4"),
    (2, "v5", True, "POLAR-14B-v0.5", "QLoRA", "2e-4"),
    (3, "v4", False, "Solar-Ko-Recovery-11B", "LoRA", "1e-4"),
    (4, "v4", False, "T3Q-ko-solar-dpo-v7.0", "LoRA", "2e-4"),
    (5, "v4", False, "POLAR-14B-v0.5", "QLoRA", "1e-4"),
    (6, "v3", False, "POLAR-14B-v0.5", "QLoRA", "2e-4"),
    (7, "v5", False, "Solar-Ko-Recovery-11B", "LoRA", "1e-4"),
    (8, "v1", False, "Solar-Ko-Recovery-11B", "LoRA", "1e-4"),
    (9, "v1", True, "Solar-Ko-Recovery-11B", "LoRA", "2e-4"),
    (10, "v1", False, "Solar-Ko-Recovery-11B", "LoRA", "2e-4"),
    (11, "v3", False, "Solar-Ko-Recovery-11B", "LoRA", "1e-4"),
)
VARIANT_DATASET_NAMES = (
    ("v1", "CustomRefDataset"),
    ("v2", "CustomRefOfficialTermDataset"),
    ("v3", "CustomRefDefinitionDataset"),
    ("v4", "CustomRefInstructionDataset"),
    ("v5", "SystemRefOfficialTermDataset"),
)
REFINED_PREFIX = "Refined_"
