import pytest
from pyspark.sql import functions as F

from symptia.functions import messages
from symptia.operators import emergency, guardrails, replies

def rules(texts, *values):
    df = guardrails.check_messages(texts(*values)).orderBy("id")
    return [(r.rule, r.violation_type, r.force_red, r.is_emergency) for r in df.collect()]


@pytest.mark.parametrize("value, rule", [
    ("some days I feel better off dead", "suicidal"),
    ("عم فكر بالإنتحار", "suicidal"),
    ("baddi mout", "suicidal"),
    ("my aunt overdosed yesterday", "overdose"),
    ("he ate a lot of berries", "overdose"),
    ("بلعت حبوب كتير", "overdose"),
    ("our baby will not sleep", "infant"),
    ("a 9 month old with a rash", "infant"),
    ("عمرو ٧ أشهر", "infant"),
    ("3omro shahrein w 3am yebke", "infant"),
    ("she is one year old", "infant"),
    ("a 27 months old boy", None),
    ("عندي سعلة من 4 أشهر", None),
    ("walking hurts since 5 months", None),
    ("contractions started", "pregnancy"),
    ("والحامل تعبانة", "pregnancy"),
    ("حملت الكنبة لحالي", None),
    ("my lab result is here", "lab"),
    ("chest pressure and jaw pain", "compound"),
    ("وجع صدر مع الفك", "compound"),
    ("وجع صدر عم فكر فيه", None),
    ("hives and throat closing", "compound"),
    ("fell and hit the floor, then vomiting", "compound"),
    ("which tablets help with pain", "medication"),
    ("شو باخد للسعلة", "medication"),
    ("my knee clicks", None),
])
def test_cascade(texts, value, rule):
    assert rules(texts, value)[0][0] == rule


def test_priority_and_flags(texts):
    got = rules(texts, "pregnant and I want to die", "pregnant and overdosed", "newborn, lab result", "lab result, what dose")
    assert [g[0] for g in got] == ["suicidal", "overdose", "infant", "lab"]
    assert [g[2] for g in got] == [False, True, True, False]
    assert [g[3] for g in got] == [True, True, True, False]


def test_emergency(column):
    yes = ["pressure on my chest since noon", "ضغط فظيع على صدري", "her face is turning blue", "grandma stopped breathing",
           "مش عم تصحى", "slurred speech since morning", "لسانو عم يتورم", "vomiting blood", "bet2ayya dam", "sugar 480",
           "السكر ٣٩", "he had a seizure", "can't feel my right leg", "زورها كلو منفخ"]
    no = ["my lips are dry", "sugar was 120", "stuffy chest from a cold", "السكر 140", "back hurts", "I read about seizures", "صدري مسكر"]
    assert column(emergency.is_emergency(F.col("text")), *yes) == [True] * len(yes)
    assert column(emergency.is_emergency(F.col("text")), *no) == [False] * len(no)


def test_refusal_text(spark):
    df = spark.createDataFrame([("suicidal_ideation", True, "english"), ("scope_lab_results", False, "arabic"),
                                ("emergency_red_flag", True, "other")], "v string, e boolean, s string")
    got = [r[0] for r in df.select(guardrails.refusal_text(F.col("v"), F.col("e"), F.col("s"))).collect()]
    notices = {(s, k): n for s, k, n in messages.NOTICES}
    assert "1564" in got[0] and notices["english", "emergency"] not in got[0]
    assert got[1].endswith(notices["arabic", "routine"])
    assert got[2].endswith(notices["english", "emergency"])  # unknown script


def test_notice_is_idempotent(column):
    once = guardrails.ensure_notice(F.col("text"), F.lit(True), F.lit("franco"))
    twice = guardrails.ensure_notice(once, F.lit(True), F.lit("franco"))
    assert column(once, "hi") == column(twice, "hi")


@pytest.mark.parametrize("raw, clean", [
    ("You have a cold.", "you may have a cold."),
    ("You are diagnosed with flu", "your symptoms may suggest flu"),
    ("This is clearly flu", "this may be flu"),
    ("use 200 mg of sugar twice", "use [dosage removed] twice"),
    ("take some Advil now", "[medication advice removed] now"),
    ("خذ panadol", "[medication advice removed]"),
    ("azithromycin or candesartan", "[medication removed] or [medication removed]"),
    ("take a walk and water", "take a walk and water"),
    ("éyou have", "éyou have"),
])
def test_redaction(column, raw, clean):
    redacted = replies.redact(F.col("text"))
    assert column(redacted, raw) == [clean]
    assert column(replies.redact(redacted), raw) == [clean]


def test_response_check(column):
    got = column(replies.response_violation(F.col("text")), "the diagnosis is plain", "10 ml at night", "brufen helps", "rest", "this is certainly 5 mg")
    assert got == ["diagnosis_language", "medication_reference", "medication_reference", None, "diagnosis_language"]
    assert column(replies.needs_hedge(F.col("text")), "you have flu", "you have maybe flu", "you might say you have flu", "ربما you have flu", "rest") == [
        True, True, False, False, False]


def test_reply_from_classification(spark):
    df = spark.createDataFrame([("english", "GREEN", ["a", "b"], ["c"]), ("arabic", "YELLOW", ["a", "b"], []), ("english", "RED", ["a"], ["b"]),
                                ("franco", "GREEN", [], [])], "s string, l string, c array<string>, a array<string>")
    got = [r[0] for r in df.select(replies.reply_from_classification(*[F.col(c) for c in "slca"])).collect()]
    copy = {(s, k): t for s, k, t in messages.FALLBACKS}
    assert got == [copy["english", "CONDITIONS"] + "a, b.\n" + copy["english", "ACTIONS"] + "c.", copy["arabic", "CONDITIONS"] + "a، b.",
                   copy["english", "RED"], copy["franco", "GREEN"]]


def test_digits_of_any_script(column):
    readings = column(emergency.glucose_readings(F.col("text")), "السكر ۴۵", "sugar ٤٦٢", "glucose १२०", "sugar 99999")
    assert readings == [[45], [462], [120], []]
    assert column(emergency.extreme_glucose(F.col("text")), "السكر ۴۵", "السكري ۱۲۰") == [True, False]
    assert column(guardrails.is_infant(F.col("text")), "عمرها ۴ أشهر", "عمرها ٤ أشهر", "عمرو ۳۰ شهر") == [True, True, False]
