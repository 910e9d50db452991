"""SQL building blocks for the independent DuckDB oracle of every registered query.

DuckDB's regex engine (RE2) has no look-behind and ASCII ``\\w``/``\\s``/``\\b``,
so the Unicode classes are spelled out and the look-arounds are rewritten with
capture groups.  The classes below mirror Java's ``(?U)`` definitions.
"""

from __future__ import annotations

from dialframe.functions import fixed

# Java (?U)\s: the Unicode White_Space property.
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Java (?U)\w: alphabetic, marks, decimal digits, connector punctuation, joiners.
WORD = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"
# Python's strip() also removes U+001C..U+001F.
STRIP = WS + r"\x{1C}-\x{1F}"

NOISE_VIEW = """
SELECT conv_id, 2 * turn + k AS turn,
       CAST(1 + (length(text) % 2 + k * ((conv_id + turn) % 2)) % 2 AS INTEGER) AS speaker,
       concat(conv_id, '.', 2 * turn + k) AS utterance_id,
       (conv_id + 2 * turn + k) % 5 = 3 AS is_ref,
       CASE WHEN k = 0 THEN concat(CASE (conv_id * 3 + turn) % 8
         WHEN 1 THEN '안녕하세요 name1입니다~ '
         WHEN 2 THEN '(웃음) 진짜????? '
         WHEN 4 THEN 'name_2!  그래....... ㅠㅡㅠ '
         WHEN 5 THEN 'ㅇㅋㅋ '
         WHEN 6 THEN '저안녕 '
         ELSE '' END, text)
       ELSE CASE (conv_id * 3 + turn) % 8
         WHEN 0 THEN 'ㅇㅇ ㅇㅇ 조심해'
         WHEN 2 THEN 'ㅋㅋㅋㅋ ㅎㅎㅎ 웃겨 ㄱㄱㄱ'
         WHEN 3 THEN 'ㅋㄱㅋㄲㅋ'
         WHEN 4 THEN '반갑습니당 저는 name2 ㅠㅠ'
         WHEN 5 THEN '^^ OK.'
         WHEN 6 THEN '네'
         WHEN 7 THEN 'ㄴㄴ ㄷㄷㄷ ㅇㅇㅇ 그래 ㅎ'
         END END AS text
FROM conversations CROSS JOIN (VALUES (0), (1)) t(k)
"""

EXAMPLES_VIEW = """
SELECT conv_id,
       CASE conv_id % 5 WHEN 0 THEN '원인' WHEN 1 THEN '후행사건' WHEN 2 THEN '전제' WHEN 3 THEN '동기'
            ELSE '반응' END AS category,
       concat('후보 가', conv_id % 7) AS inference_1, concat('후보 나', conv_id % 5) AS inference_2,
       concat('후보 다', conv_id % 3) AS inference_3,
       CASE WHEN conv_id % 4 = 0 THEN '' ELSE concat('inference_', conv_id % 3 + 1) END AS output,
       CASE WHEN conv_id % 10 < 7 THEN 'train' WHEN conv_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT DISTINCT conv_id FROM conversations) d
"""


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{STRIP}]+|[{STRIP}]+$', '', 'g')"


def clean_sql(x: str) -> str:
    """The cleaning chain as one DuckDB expression over the text expression ``x``."""
    t = f"coalesce(CAST({x} AS VARCHAR), 'None')"
    t = f"replace(replace({t}, chr(10), ' '), '  ', ' ')"
    run = f"'(^|[{WS}])ㅇ{{2,}}($|[{WS}])'"
    # A match consumes its trailing space, so a second pass catches neighbours.
    t = f"regexp_replace(regexp_replace({t}, {run}, '\\1응\\2', 'g'), {run}, '\\1응\\2', 'g')"
    t = f"regexp_replace({t}, '\\.{{4,}}', '...', 'g')"
    t = f"regexp_replace({t}, '\\?{{2,}}', '??', 'g')"
    t = f"translate({t}, '{fixed.SPECIAL_CHARACTERS}', '')"
    for stem in fixed.GREETING_STEMS:
        t = f"regexp_replace({t}, '(^|[^{WORD}]){stem}[{WORD}]*', '\\1', 'g')"
    for old, new in fixed.NAME_ALIASES:
        t = f"replace({t}, '{old}', '{new}')"
    t = f"regexp_replace({t}, '{fixed.JAMO_CLASS}+', '', 'g')"
    return t


def blank_non_hangul_sql(t: str) -> str:
    return (f"CASE WHEN NOT regexp_matches({t}, '[가-힣]') AND regexp_matches({t}, '[^{WORD}{WS}]') "
            f"THEN '' ELSE {t} END")


CLEAN_STAGES = f"""
c0 AS (SELECT conv_id, turn, speaker, utterance_id, is_ref, {clean_sql('text')} AS t FROM v),
c1 AS (SELECT conv_id, turn, speaker, utterance_id, is_ref, {blank_non_hangul_sql('t')} AS t FROM c0),
cleaned AS (SELECT conv_id, turn, speaker, utterance_id, is_ref, {strip_sql('t')} AS text FROM c1)
"""

# Gaps and islands over the surviving cleaned utterances.
MERGE_STAGES = """
s AS (SELECT * FROM cleaned WHERE text <> ''),
m AS (SELECT *, lag(speaker) OVER w AS ps, lag(is_ref) OVER w AS pr, row_number() OVER w AS rn
      FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, CASE WHEN rn = 1 OR speaker <> ps OR is_ref OR pr THEN 1 ELSE 0 END AS brk FROM m),
r AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b),
merged AS (SELECT conv_id, run, min(turn) AS start_turn, min(speaker) AS speaker,
                  string_agg(text, ' ' ORDER BY turn) AS text,
                  string_agg(utterance_id, ',' ORDER BY turn) AS utterance_ids,
                  count(*) AS n_turns
           FROM r GROUP BY conv_id, run)
"""
