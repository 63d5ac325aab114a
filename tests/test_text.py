from pyspark.sql import functions as F
import pytest

from symptia.functions import parsing, text

T = "text"


def test_normalize(column):
    assert column(text.normalize(T), "أَلَم", "إنسان", "آلام", "صحة", "مرضى", "  وجع  ", "", "شَدِيدٌ") == [
        "الم", "انسان", "الام", "صحه", "مرضي", "وجع", "", "شديد"]


def test_language(column):
    got = column(text.detect_language(T), "وجع بالضهر", "3am yuja3ne rase", "plain english words", "", " \n ", "وجع head", "2024", "room 14", "قَلْبِي")
    assert got == ["arabic", "franco_arab", "english", "english", "english", "arabic", "english", "english", "arabic"]


def test_language_share_is_strict(column):
    # two of five characters is exactly the limit
    assert column(text.detect_language(T), "وجabc") == ["english"]


def test_script_choice(spark):
    rows = [("english", "franco", "وجع"), ("auto", "franco", "وجع"), ("auto", "arabic", "وجع"), ("auto", "arabic", "pain"), ("arabic", "arabic", "pain")]
    df = spark.createDataFrame(rows, "p string, r string, m string")
    got = [r[0] for r in df.select(text.output_script(F.col("p"), F.col("r"), F.col("m"))).collect()]
    assert got == ["english", "franco", "arabic", "english", "arabic"]


def test_transliterate(column):
    got = column(text.transliterate(T), "shu", "KHobz", "taxi", "e a", "عندي sadr", "Ünï", "", "gh th ch ph dh")
    assert got == ["شو", "خوبز", "تاكسي", " ا", "عندي سادر", "Üنï", "", "غ ث ش ف ذ"]


def test_keyword_tokens(column):
    got = column(text.keyword_tokens(T), "The patients HAVE a Fever, über-lang x_1 ok", "وَجع")
    assert got[0] == ["fever", "über", "lang", "x_1"]
    assert got[1] == []  # a mark splits the word in two short runs


def test_ngrams(column):
    toks = text.symptom_tokens(T)
    assert column(text.ngrams(toks, 2), "a b, ج", "a") == [["a b", "b ج"], []]


def test_pieces_concatenate(column):
    values = ["Hello,  big\n\nworld!! 3.5", "عندي وجع", "", " \t x", "a😀b"]
    assert column(F.array_join(text.pieces(T), ""), *values) == values


def test_category(column):
    got = column(text.category(T), "Heart_cardio.md", "child_lung.txt", "misc.txt", "emergency_triage.md")
    assert got == ["cardiovascular", "respiratory", "general", "emergency"]


def test_small_projections(column):
    assert column(text.ellipsis(T), "x" * 41, "x" * 40) == ["x" * 40 + "...", "x" * 40]
    assert column(text.with_folded(T), "أفكار", "plain") == ["أفكار\nافكار", "plain"]
    assert column(text.ordered_distinct(F.col(T), F.lit("b"), F.lit(""), F.col(T)), "a", "b") == [["a", "b"], ["b"]]
    assert column(text.fill("Q: {q} / {q2}", q=F.col(T), q2=F.lit("x")), "a{b}") == ["Q: a{b} / x"]
    assert column(text.rounded(F.lit(0.12345), 4), "") == [0.1234]


@pytest.mark.parametrize("raw, level, conditions", [
    ('{"triage_level": "RED", "possible_conditions": ["a"], "recommended_actions": []}', "RED", ["a"]),
    ('```json\n{"triage_level": "green"}\n```', "GREEN", []),
    ('{"triage_level": "BLUE", "possible_conditions": ["a"]}', "YELLOW", ["a"]),
    ('{"triage_level": "RED", "possible_conditions": ["a", "b', "RED", ["a", "b"]),
    ('{"triage_level": "RED", "possible_conditions": ["a"],', "RED", ["a"]),
    ('{"triage_level": "RED"} and more', "YELLOW", []),
    ("Here you go: no json", "YELLOW", []),
    ("{'triage_level': 'RED'}", "YELLOW", []),
    ('{"triage_level": "RED", "possible_conditions": ["1","2","3","4","5","6"]}', "RED", ["1", "2", "3", "4", "5"]),
    (None, "YELLOW", []),
    ('{"triage_level": "RED", "possible_conditions": ["brace } and { bracket ]"]}', "RED", ["brace } and { bracket ]"]),
])
def test_parse_verdict(column, raw, level, conditions):
    got = column(parsing.parse_verdict(F.col(T)), raw)[0]
    assert (got.level, got.conditions) == (level, conditions)


def test_parse_numbers(column):
    assert column(parsing.parse_score(F.col(T)), "0.8", "1.7 x", "-3", "high", "0.9f", "", None, "nan", "5e-1") == [
        0.8, 1.0, 0.0, -1.0, -1.0, -1.0, -1.0, -1.0, 0.5]
    assert column(parsing.parse_rating(F.col(T)), " 4", "6", "five", "", None, "3/5") == [4.0, None, None, None, None, 3.0]


def test_rounding_is_that_of_the_binary_value(spark):
    """Against Python's round, on doubles at and next to halves."""
    import math
    import random

    draw = random.Random(6)
    for digits in (0, 1, 2, 4):
        values = [0.15, 2.675, 0.12345, 0.125, 0.375, 0.5, 1.5, 2.5, -0.15, -0.001, 0.0, 1e300, -1e22, 5e-324, 2.0**52 + 0.5, 2.0**53 / 10**digits]
        while len(values) < 25_000:
            x = (draw.randrange(10 ** draw.randrange(1, 13)) + 0.5) / 10**digits
            values += [x, math.nextafter(x, 9e99), -math.nextafter(x, 0), draw.random() * 10 ** draw.randrange(-5, 16)]
        rows = spark.createDataFrame(list(enumerate(values)), "id int, x double")
        got = {r.id: r.v for r in rows.select("id", text.rounded("x", digits).alias("v")).collect()}
        wrong = [(x, got[i], round(x, digits)) for i, x in enumerate(values) if repr(got[i]) != repr(float(round(x, digits)))]
        assert not wrong, wrong[:5]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double").select(text.rounded("x", 2).alias("v"))
    assert [repr(r.v) for r in odd.collect()] == ["None", "nan", "inf", "-inf"]
