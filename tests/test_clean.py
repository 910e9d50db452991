from pyspark.sql import functions as F

from dialframe.functions.text import clean_utterance, squeeze_jamo_runs

NBSP = " "

# (input, expected) hand-derived from the cleaning rules
CASES = [
    ("ㅇㅇ 조심해", "응 조심해"), ("ㅇㅇㅇ", "응"), ("ㅇㅇ ㅇㅇ", "응 응"),
    ("ㅇㅇ~", ""), ("ㅇㅇ, 그래", ", 그래"), ("응응ㅇㅇ", "응응"),
    ("그래.......", "그래..."), ("진짜?????", "진짜??"), ("진짜?", "진짜?"),
    ("...", ""), ("안녕하세요 name1입니다~", "화자1입니다"), ("반갑습니당", ""),
    ("저안녕", "저안녕"), ("안녕! 반갑습니다.", ""), ("name1", "화자1"),
    ("name_2!", "화자2"), ("ㅋㄱㅋㄲㅋ", ""), ("좋아ㅋㅋㅋ", "좋아"),
    ("ㅠ ㅠ 힘들다", "힘들다"), ("OK", "OK"), ("OK.", ""),
    ("123", "123"), ("3.5", ""), ("^^", ""),
    ("(웃음) 그래^^", "웃음 그래"), ("a    b", "a  b"), ("가\n나", "가 나"),
    ("가 \n 나", "가  나"), (None, "None"), (NBSP + "그래\t", "그래"), ("  그래 ", "그래"),
    ("", ""),
]


def test_clean_fixture_table(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = dict(df.select("i", clean_utterance("t").alias("c")).collect())
    for i, (src, want) in enumerate(CASES):
        assert got[i] == want, (src, got[i], want)


def test_clean_never_leaves_jamo(spark):
    df = spark.createDataFrame([("ㅋㅋ 좋다 ㅎㅎ",), ("ㅏㅏ ㄱ",), ("ㅇㅇ ㅇㅇ 조심해",)], "t string")
    out = [r[0] for r in df.select(clean_utterance("t")).collect()]
    assert all(not any("ㄱ" <= ch <= "ㅣ" for ch in s) for s in out)


def test_squeeze(spark):
    df = spark.createDataFrame([("ㅋ",), ("ㅋㅋㅋㅋ",), ("ㅎㅎㅎ하",), ("ㄷㄷㄷ",)], "t string")
    out = [r[0] for r in df.select(squeeze_jamo_runs(F.col("t"))).collect()]
    assert out == ["ㅋㅋ", "ㅋㅋ", "ㅎㅎ하", "ㄷㄷ"]


def test_unicode_class_edges(spark):
    # \s is the White_Space property (U+001C..U+001F are not in it), strip() also removes them;
    # \w includes letter numbers, connector punctuation, join controls and other-alphabetic symbols.
    cases = [("OK\x1c", ""), ("Ⅻ", "Ⅻ"), ("Ⓐ", "Ⓐ"), ("가\x1c", "가"), ("a‿b", "a‿b"), ("²", "")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = dict(df.select("i", clean_utterance("t").alias("c")).collect())
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_sql_functions_match_columns(spark):
    from dialframe.functions.hangul import has_final_consonant
    from dialframe.functions.sql_functions import register_sql_functions
    from dialframe.operators.encode import code_points
    names = register_sql_functions(spark)
    assert "dialframe_clean" in names
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    df.createOrReplaceTempView("clean_cases")
    sql = spark.sql("SELECT i, dialframe_clean(t) AS c, dialframe_has_final_consonant(t) AS f, "
                    "dialframe_code_points(t) AS p, dialframe_squeeze_jamo(t) AS q FROM clean_cases")
    api = df.select("i", clean_utterance("t").alias("c"), has_final_consonant(F.col("t")).alias("f"),
                    code_points(F.col("t")).alias("p"), squeeze_jamo_runs(F.col("t")).alias("q"))
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, api.collect()))
