"""Reply copy by script, as small literal tables joined or looked up by key."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCRIPTS = ["arabic", "franco", "english"]

# (violation_type, script) -> refusal
REFUSALS = [
    ("scope_infant", "english", "Children younger than two are outside what this service can assess. Please see a pediatrician or an emergency room straight away."),
    ("scope_infant", "arabic", "تقييم الأطفال تحت السنتين برّا نطاق هالخدمة. شوفوا دكتور أطفال أو الطوارئ بسرعة."),
    ("scope_infant", "franco", "ta2yim l atfal ta7t l senten barra nita2 hal khedme. shufo doctor atfal aw l taware2 b ser3a."),
    ("scope_pregnancy", "english", "Questions about pregnancy need your obstetrician. Please call them or go to the closest maternity ward."),
    ("scope_pregnancy", "arabic", "أسئلة الحمل بدها دكتور نسائي. احكي معو أو روحي على أقرب قسم توليد."),
    ("scope_pregnancy", "franco", "as2ilet l 7aml badda doctor nse2e. 7ke ma3o aw ru7e 3a a2rab 2esem tawlid."),
    ("scope_lab_results", "english", "Reading lab reports or scans is for your own doctor. Please go through them together."),
    ("scope_lab_results", "arabic", "قراءة التحاليل والصور شغلة دكتورك. راجعها معو."),
    ("scope_lab_results", "franco", "2rayet l ta7alil w l suwar sheghlet doctorak. raje3a ma3o."),
    ("emergency_red_flag", "english", "This may be an emergency. Phone 140 or get to an emergency room now, without waiting."),
    ("emergency_red_flag", "arabic", "هيدا ممكن يكون طارئ. دق على 140 أو وصّل عالطوارئ هلق بلا ما تنطر."),
    ("emergency_red_flag", "franco", "hayda momken ykun tare2. de2 3a 140 aw wsal 3al taware2 hala2 bala ma tontor."),
    ("suicidal_ideation", "english", "What you wrote matters and you deserve support right now. Phone the 1564 lifeline, or 140 if you are in danger, or walk into any emergency room. Someone will be with you."),
    ("suicidal_ideation", "arabic", "يلي كتبتو مهم وبتستاهل دعم هلق. دق على خط الدعم 1564، أو 140 إذا في خطر، أو فوت على أي طوارئ. في مين يكون حدك."),
    ("suicidal_ideation", "franco", "yalle katabto mhemm w btestehal da3em hala2. de2 3a khat l da3em 1564, aw 140 eza fi khatar, aw fut 3a ayya taware2. fi min ykun 7addak."),
    ("scope_medication", "english", "Choosing medicines or amounts is for a pharmacist or doctor. If you may have taken too much, phone 140 or go to an emergency room now."),
    ("scope_medication", "arabic", "اختيار الدوا والكمية للصيدلي أو الدكتور. إذا أخدت كتير دق على 140 أو روح عالطوارئ هلق."),
    ("scope_medication", "franco", "ekhtiyar l dawa w l kammiye lal saydale aw l doctor. eza akhadet ktir de2 3a 140 aw ru7 3al taware2 hala2."),
]

# (script, severity) -> notice appended by the guardrails
NOTICES = [
    ("english", "routine", "⚠️ This is not a substitute for a doctor. Seek care if you feel worse."),
    ("english", "emergency", "\U0001f6a8 These signs need urgent care. Phone 140 or go to an emergency room."),
    ("arabic", "routine", "⚠️ هالكلام ما بيحل محل الدكتور. إذا ساء الوضع اطلب عناية."),
    ("arabic", "emergency", "\U0001f6a8 هالعوارض بدها عناية مستعجلة. دق على 140 أو روح عالطوارئ."),
    ("franco", "routine", "hal kalem ma b7ell ma7al l doctor. eza se2 l wade3 tlob 3ineye."),
    ("franco", "emergency", "hal 3awared badda 3ineye mesta3jle. de2 3a 140 aw ru7 3al taware2."),
]
HEDGE_NOTICE = "This case is not certain. A doctor should take a proper look."

# (script, kind) -> copy used when no model text is available
FALLBACKS = [
    ("arabic", "GREEN", "ما في جواب مفصّل هلق، بس الوضع مش مبيّن مستعجل. ارتاح واشرب مي، وشوف دكتور إذا ما تحسّن."),
    ("arabic", "YELLOW", "ما في تحليل مفصّل هلق. للأمان شوف دكتور بيوم أو يومين، وإذا زادت العوارض دق على 140."),
    ("arabic", "RED", "هالعوارض ممكن تكون خطرة. روح عالطوارئ فوراً أو دق على 140."),
    ("arabic", "CLARIFY", "احكيلي أكتر: شو حاسس، من إيمتى، وقديش قوي؟"),
    ("arabic", "CONDITIONS", "من الاحتمالات: "),
    ("arabic", "ACTIONS", "يلي بينعمل: "),
    ("franco", "GREEN", "ma fi jaweb mfassal hala2, bas l wade3 msh mbayyan mesta3jel. rte7 w shrab may, w shuf doctor eza ma t7assan."),
    ("franco", "YELLOW", "ma fi ta7lil mfassal hala2. lal amen shuf doctor b yom aw yomen, w eza zedo l 3awared de2 3a 140."),
    ("franco", "RED", "hal 3awared momken tkun khatra. ru7 3al taware2 fawran aw de2 3a 140."),
    ("franco", "CLARIFY", "7kile aktar: shu 7ases, men emta, w 2adde 2awe?"),
    ("franco", "CONDITIONS", "men l e7timelet: "),
    ("franco", "ACTIONS", "yalle byen3amal: "),
    ("english", "GREEN", "A detailed answer is not available now, but nothing here looks urgent. Rest, drink water, and see a doctor if it lingers."),
    ("english", "YELLOW", "A detailed reading is not available now. To stay safe see a doctor in a day or two, and phone 140 if it gets worse."),
    ("english", "RED", "These signs may be serious. Go to an emergency room now or phone 140."),
    ("english", "CLARIFY", "Please say more: what do you feel, since when, and how strong is it?"),
    ("english", "CONDITIONS", "Possibilities: "),
    ("english", "ACTIONS", "Next steps: "),
]
DEFAULT_FALLBACK_SCRIPT = "arabic"

# (script, level) -> suggested actions, separated by "; "
ACTIONS = [
    ("arabic", "YELLOW", "زيارة دكتور خلال 24-48 ساعة"),
    ("arabic", "RED", "دق على 140; روح عالطوارئ فوراً"),
    ("franco", "YELLOW", "ziyaret doctor khilel 24-48 se3a"),
    ("franco", "RED", "de2 3a 140; ru7 3al taware2 fawran"),
    ("english", "YELLOW", "Visit a doctor within 24-48 hours"),
    ("english", "RED", "Phone 140; Go to an emergency room now"),
]

# (script, severity) -> notice the triage step attaches to its own result
RESULT_NOTICES = [
    ("english", "routine", "⚠️ Not a substitute for a doctor. See one if things worsen."),
    ("english", "emergency", "\U0001f6a8 This is serious. Emergency room now, or phone 140!"),
    ("arabic", "routine", "⚠️ هالكلام مش بدل الدكتور. إذا ساءت الحالة شوف طبيب."),
    ("arabic", "emergency", "\U0001f6a8 الحالة جدّية. عالطوارئ هلق أو دق على 140!"),
    ("franco", "routine", "hal kalem msh badal l doctor. eza se2et l 7ale shuf tabib."),
    ("franco", "emergency", "l 7ale jeddiye. 3al taware2 hala2 aw de2 3a 140!"),
]

REFUSAL_TEXT = "This case is outside what can be handled here. A doctor is the right person for babies, pregnancies or reports."
REFUSAL_ACTION = "See a doctor without delay"
EMERGENCY_CONDITION = "emergency"
NO_CONTEXT = "No extra background found."

PROMPTS = {
    "rerank": "Score from 0.0 to 1.0 how well the passage answers the question. Answer with the number only.\n\nQuestion: {query}\n\nPassage:\n{chunk}\n\nScore:",
    "triage": "Symptoms: {symptoms_text}\n\nBackground:\n{context}\n\nGive the urgency as JSON with triage_level (GREEN, YELLOW or RED), possible_conditions and recommended_actions, written in {output_script}.\n\nJSON:",
    "response": "Symptoms: {symptoms_text}\nUrgency: {triage_level}\nConditions: {conditions}\nActions: {actions}\n\nWrite two or three kind sentences. No medicine names, no amounts, no certainty.\n\nReply:",
    "clarification": 'The patient wrote: "{query}"\n\nSymptoms found: {symptoms_text}\n\nAsk one short question that would make this clearer:',
    "quality": "Patient wrote: {input_text}\nExpected urgency: {expected_level}\nGiven urgency: {actual_level}\nReply: {response_text}\n\nRate the reply from 1 to 5. Answer with the digit only.",
}
OUTPUT_SCRIPTS = [("english", "English"), ("franco", "Latin-letter Arabic"), ("arabic", "Lebanese Arabic")]


def table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A literal dimension table; its size is fixed by the source text."""
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def pick(rows: list[tuple[str, str, str]], first: Column, second: Column, default_first: str) -> Column:
    """The text for a key pair, falling back to ``default_first`` for an
    unknown first key. A literal map, so no join and no shuffle."""
    known = {f"{a}|{b}": text for a, b, text in rows}
    # folded to a map literal by the optimizer
    mapping = F.from_json(F.lit(json.dumps(known, ensure_ascii=False)), "map<string,string>")
    return F.coalesce(
        mapping[F.concat_ws("|", first, second)],
        mapping[F.concat(F.lit(default_first + "|"), second)],
    )


def refusal(violation: Column, script: Column) -> Column:
    rows = [(s, v, t) for v, s, t in REFUSALS]
    return pick(rows, script, violation, "english")


def notice(script: Column, emergency: Column) -> Column:
    return pick(NOTICES, script, F.when(emergency, "emergency").otherwise("routine"), "english")


def result_notice(script: Column, emergency: Column) -> Column:
    return pick(RESULT_NOTICES, script, F.when(emergency, "emergency").otherwise("routine"), "arabic")


def fallback(script: Column, kind: Column) -> Column:
    return pick(FALLBACKS, script, kind, DEFAULT_FALLBACK_SCRIPT)


def fallback_actions(script: Column, level: Column) -> Column:
    key = F.when(level == "RED", "RED").otherwise("YELLOW")
    return F.split(pick(ACTIONS, script, key, DEFAULT_FALLBACK_SCRIPT), "; ")


def output_script_name(script: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in OUTPUT_SCRIPTS for x in kv])
    return F.coalesce(mapping[script], F.lit(dict(OUTPUT_SCRIPTS)["arabic"]))
