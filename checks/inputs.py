"""Inputs for the registered queries, derived from the given tables.

The tables hold no symptom text, so every row gets one phrase appended, picked
by its ids from a short literal list. No row is dropped. Each derived input
exists twice: as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions.regexes import any_literal
from symptia.session import shared_dir, spread

USER_PHRASES = [
    "my throat feels sore since monday",
    "i want to die and nobody listens",
    "عندي أفكار إنتحار من جمعة",
    "grandpa overdosed on something",
    "she swallowed a whole bottle of syrup",
    "عمر بنتي ٤ أشهر وما عم تاكل",
    "our baby cries all night",
    "the boy is 31 months old and coughs",
    "ebne 3emro 7 ashhor w sokhn",
    "مرتي بالحمل وعندها دوخة",
    "حملت كيس تقيل ووجعني كتفي",
    "is travel fine when pregnant",
    "the x-ray result came back today",
    "نتيجة تحليل الدم طلعت عالية",
    "chest pain that spreads to the left arm",
    "عندي وجع صدر وبفكر ارتاح",
    "وجع بالصدر وفكي كمان عم يوجعني",
    "hives everywhere and shortness of breath",
    "خبطت راسي وعم استفرغ من الصبح",
    "which dose of the syrup is right",
    "شو دوا منيح للسعلة",
    "my sugar is 462 since lunch",
    "السكري عندي ٤٥ وعم برجف",
    "sugar was 118 before breakfast",
    "ضغط كبير على صدري",
    "his lips are turning blue now",
    "لسان اخي عم يتورم",
    "3andi waj3it ras w dawkha",
    "عندي دوخة ووجع ضهر",
    "7arara w so3al men mbere7",
    "dizzy and tired, mild fever",
    "مش عم يوعى ابدا",
    "she is coughing up blood",
    "no breakfast today, just coffee",
    "عندي كحة خفيفة وبلغم",
    "رضيع عندو حرارة",
    "السكر ۴۵ ومش منيح",
    "السكري صار ۱۲۰ بعد الغدا",
    "عمرها ۴ أشهر وعم تبكي",
    "عمرو ۳۰ شهر وعندو كحة",
    "3andi sodaa3 w ta3ab men youmein",
    "ok",
]
REPLY_PHRASES = [
    "Rest well and drink water.",
    "You have a cold, nothing more.",
    "You are diagnosed with gastritis.",
    "This is definitely a migraine.",
    "Take some ibuprofen after food.",
    "Take 500 mg of paracetamol at night.",
    "It could be that you have low iron.",
    "A short walk may help.",
    "Doctors often use amoxicillin or erythromycin.",
    "Please take a rest now.",
    "The diagnosis is clear.",
    "This is certainly from the 2 tablets of panadol you took.",
    "ممكن يكون برد، خذ panadol بعد الاكل",
    "Keep the leg up and possibly use ice.",
    "10 ml before sleep, then call.",
    "You suffer from stress.",
    "See a doctor within two days.",
]
LEXICON_ROWS = [
    # dialect_term, latin, msa, english, category, body_system, severity
    ("وجع", "waj3a", "ألم", "ache", "pain_descriptions", "general", "moderate"),
    ("وجع راس", "waj3it ras", "صداع", "head ache", "common_symptoms", "neurological", "mild_to_moderate"),
    ("دوخة", "dawkh", "دوار", "vertigo", "common_symptoms", "neurological", "mild_to_moderate"),
    ("حرارة", "7arar", "حمى", "raised temperature", "common_symptoms", "general", "moderate"),
    # terms that are themselves in Latin letters
    ("sodaa3", "", "صداع", "head ache", "common_symptoms", "neurological", "mild_to_moderate"),
    ("ta3ab", "ta3ab", "تعب", "fatigue", "common_symptoms", "general", "mild_to_moderate"),
    ("كحة", "ko7a", "سعال", "cough", "respiratory", "respiratory", "mild_to_moderate"),
    ("وجع ضهر", "waja3 daher", "ألم الظهر", "back pain", "pain_descriptions", "musculoskeletal", "moderate"),
    ("ضغط", "daght", "ضغط الدم", "blood pressure", "chronic_conditions", "cardiovascular", "moderate"),
    ("نزيف", "nazif", "نزف", "bleeding", "emergency_phrases", "general", "critical"),
    ("سعلة", "so3al", "سعال", "cough", "respiratory", "respiratory", "mild_to_moderate"),
    ("بلغم", "balgham", "بلغم", "phlegm", "respiratory", "respiratory", "mild_to_moderate"),
    ("راس", "ras", "رأس", "head", "body_parts", "neurological", "mild_to_moderate"),
    ("صدر", "sadr", "صدر", "chest", "body_parts", "cardiovascular", "moderate_to_critical"),
    ("حرارة عالية", "7arar", "حمى شديدة", "high fever", "common_symptoms", "general", "severe"),
    ("تعب", "tired", "تعب", "", "common_symptoms", "general", "mild_to_moderate"),
    ("", "fever", "حمى", "fever", "common_symptoms", "general", "moderate"),
    ("قهوة", "coffee,", "قهوة", "", "common_symptoms", "digestive", "mild_to_moderate"),
    ("وعي", "wa3e", "وعي", "consciousness", "emergency_phrases", "neurological", "critical"),
    ("كتف", "ktef ", "كتف", "shoulder", "body_parts", "musculoskeletal", "mild_to_moderate"),
    ("دم", "dam", "دم", "blood", "body_parts", "cardiovascular", "severe"),
]
LEXICON_COLUMNS = [
    "dialect_term", "dialect_term_latin", "msa_equivalent", "english_medical_term",
    "category", "body_system", "severity_hint",
]
NAME_HINTS = ["cardio", "lung_notes", "gastro", "Pediatric", "notes", "triage", "HEART", "mental", "report"]


def q(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"CAST({value} AS BIGINT)"
    if isinstance(value, float):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def re2(pattern: str) -> str:
    """A fixed pattern for RE2: spelled-out classes, boundaries instead of
    lookarounds (enough for a yes/no search)."""
    for old, new in [
        (r"\w", r"[\p{L}\p{N}_]"),
        (r"\d", r"\p{Nd}"),
        (r"\D", r"\P{Nd}"),
        (f"(?<![{'؀'}-{'ۿ'}])", "(?:^|[^؀-ۿ])"),
        (f"(?![{'؀'}-{'ۿ'}])", "(?:$|[^؀-ۿ])"),
    ]:
        pattern = pattern.replace(old, new)
    return pattern


def sql_any(col: str, patterns: list[str] | str) -> str:
    patterns = [patterns] if isinstance(patterns, str) else patterns
    joined = "(?i)" + "|".join(f"(?:{re2(p)})" for p in patterns)
    return f"regexp_matches({col}, {q(joined)})"


def sql_literals(col: str, literals: list[str]) -> str:
    return f"regexp_matches({col}, {q(any_literal(literals).replace('(?iu)', '(?i)'))})"


def sql_fold(col: str) -> str:
    return f"translate({col}, {q(fv.ALEF_FROM)}, {q(fv.ALEF_TO)})"


def sql_doubled(col: str) -> str:
    return f"CASE WHEN {sql_fold(col)} <> {col} THEN {col} || chr(10) || {sql_fold(col)} ELSE {col} END"


WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in fv.WHITESPACE) + "]"
TRIM = "concat(" + ", ".join(f"chr({ord(c)})" for c in fv.WHITESPACE) + ")"


def sql_strip(col: str) -> str:
    return f"trim({col}, {TRIM})"


def sql_words(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, {q(WS + '+')}), lambda w: w <> '')"


def sql_normalize(col: str) -> str:
    return sql_strip(
        f"translate(regexp_replace({col}, {q(fv.DIACRITICS)}, '', 'g'), {q(fv.FOLD_FROM)}, {q(fv.FOLD_TO)})"
    )


def sql_language(col: str) -> str:
    dense = f"regexp_replace({col}, {q(WS)}, '', 'g')"
    arabic = f"length(regexp_replace({dense}, '[^{fv.ARABIC_BLOCK}]', '', 'g'))"
    return (
        f"CASE WHEN length({dense}) = 0 THEN 'english' "
        f"WHEN {arabic} / length({dense}) > {fv.ARABIC_SHARE} THEN 'arabic' "
        f"WHEN regexp_matches({col}, {q(fv.FRANCO_DIGITS)}) AND regexp_matches({col}, '[a-zA-Z]') "
        f"THEN 'franco_arab' ELSE 'english' END"
    )


def sql_script(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, '[{fv.ARABIC_LETTERS}]') THEN 'arabic' ELSE 'english' END"


# ------------------------------------------------------------ derived inputs
TEXT_TABLES = ["documents", "conversations", "pages"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in TEXT_TABLES else df


def _with_phrase(df: DataFrame, phrases: list[str], number) -> DataFrame:
    lookup = F.array(*[F.lit(p) for p in phrases])
    return df.withColumn(
        "text", F.concat("text", F.lit(" "), F.element_at(lookup, (number % len(phrases) + 1).cast("int")))
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with one symptom phrase each."""
    df = read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return _with_phrase(df, USER_PHRASES, F.col("conv_id") * 31 + F.col("turn") * 7)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with one model-style sentence each."""
    df = read(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return _with_phrase(df, REPLY_PHRASES, F.col("conv_id") * 3 + F.col("turn"))


def corpus_of(documents: DataFrame) -> DataFrame:
    """Documents as named files; the first word of a paragraph is its heading."""
    hints = F.array(*[F.lit(h) for h in NAME_HINTS])
    name = F.concat(
        F.element_at(hints, (F.col("doc_id") % len(NAME_HINTS) + 1).cast("int")),
        F.lit("_"), F.col("doc_id"), F.when(F.col("lang") == "en", ".md").otherwise(".txt"),
    )
    headed = F.regexp_replace("text", r"\n(\p{L}+)", "\n# $1\n$1")
    return documents.select("doc_id", name.alias("source_name"), F.lit(0).alias("page_number"), headed.alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_of(read(spark, sf_dir, "documents"))


def corpus_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder in shared storage with every page as a file of its name, and
    one file and one subfolder that no scan picks up."""
    folder = shared_dir(spark, "corpus")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(f"{path}/deeper.txt", recursive=True)
        for batch in batches:
            for name, text in [*zip(*(c.to_pylist() for c in batch.columns)), ("notes.docx", "x"), ("deeper.txt/inner.txt", "x")]:
                # a repeated attempt writes the same bytes again
                with files.open_output_stream(f"{path}/{name}") as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    corpus(spark, sf_dir).select("source_name", "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(LEXICON_ROWS)]
    return spark.createDataFrame(rows, "entry_no int, " + ", ".join(f"{c} string" for c in LEXICON_COLUMNS))


def _phrase_sql(name: str, phrases: list[str], role: str, number: str) -> str:
    return (
        f"{name}_phrases AS (SELECT * FROM (VALUES "
        + ", ".join(f"({i}, {q(p)})" for i, p in enumerate(phrases))
        + ") AS v(no, phrase)), "
        f"{name} AS (SELECT conv_id, turn, role, text || ' ' || phrase AS text FROM conversations "
        f"JOIN {name}_phrases ON no = ({number}) % {len(phrases)} WHERE role = '{role}')"
    )


MESSAGES = _phrase_sql("messages", USER_PHRASES, "user", "conv_id * 31 + turn * 7")
REPLIES = _phrase_sql("replies", REPLY_PHRASES, "assistant", "conv_id * 3 + turn")
CORPUS = (
    "hints AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {q(h)})" for i, h in enumerate(NAME_HINTS))
    + ") AS v(no, hint)), corpus AS (SELECT doc_id, hint || '_' || doc_id || CASE WHEN lang = 'en' THEN '.md' ELSE '.txt' END AS source_name, "
    "CAST(0 AS BIGINT) AS page_number, regexp_replace(text, '\\n(\\p{L}+)', chr(10) || '# \\1' || chr(10) || '\\1', 'g') AS text "
    f"FROM documents JOIN hints ON no = doc_id % {len(NAME_HINTS)})"
)
LEXICON = values(
    "lexicon", ["entry_no", *LEXICON_COLUMNS], [(i, *r) for i, r in enumerate(LEXICON_ROWS)]
)
