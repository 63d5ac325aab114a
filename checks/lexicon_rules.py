"""Queries and SQL twins for dictionary matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import (
    LEXICON, MESSAGES, lexicon, messages, q, read, sql_language, sql_normalize, sql_strip, sql_words,
)
from checks.text_rules import sql_ngrams
from symptia.functions import fixed_values as fv
from symptia.operators import lexicon as lex

QUERIES, SQL = {}, {}
ID = ["conv_id", "turn"]

SQL_INDEX = (
    f"arabic_keys AS (SELECT {sql_normalize('dialect_term')} AS key, * FROM lexicon), "
    f"latin_keys AS (SELECT {sql_strip('lower(dialect_term_latin)')} AS key, * FROM lexicon), "
    "arabic_index AS (SELECT * FROM (SELECT *, min(entry_no) OVER (PARTITION BY key) AS place, "
    "row_number() OVER (PARTITION BY key ORDER BY entry_no DESC) AS rn FROM arabic_keys WHERE key <> '') WHERE rn = 1), "
    "latin_index AS (SELECT * FROM (SELECT *, min(entry_no) OVER (PARTITION BY key) AS place, "
    "row_number() OVER (PARTITION BY key ORDER BY entry_no DESC) AS rn FROM latin_keys WHERE key <> '') WHERE rn = 1)"
)
TOKENS = f"regexp_extract_all(text, '[{fv.ARABIC_BLOCK}]+|[a-zA-Z0-9]+')"


def sql_windows(source: str, ids: str) -> str:
    """Every window of every text, then the text itself."""
    grams = " UNION ALL ".join(
        f"SELECT {ids}, CAST(1 AS BIGINT) AS pass_no, CAST({n} AS BIGINT) AS n, unnest(range(0, len(g{n}))) AS pos, unnest(g{n}) AS w FROM grams" for n in (1, 2, 3)
    )
    return (
        f"toks AS (SELECT {ids}, text, {TOKENS} AS t FROM {source}), "
        f"grams AS (SELECT {ids}, " + ", ".join(f"{sql_ngrams('t', n)} AS g{n}" for n in (1, 2, 3)) + " FROM toks), "
        f"windows AS ({grams} UNION ALL SELECT {ids}, 2, 0, 0, text FROM {source})"
    )


def sql_hits(ids: str) -> str:
    prefixed = ", ".join(f"w.{c}" for c in ids.split(", "))
    norm = sql_normalize("w")
    return (
        f"cands AS (SELECT {ids}, pass_no, n, pos, unnest(range(0, 1 + len(c))) AS candidate, unnest(list_concat([nw], c)) AS key "
        f"FROM (SELECT *, {sql_words('nw')} AS c FROM (SELECT *, {norm} AS nw FROM windows WHERE ({sql_language('w')}) IN ('arabic', 'franco_arab')))), "
        f"arabic_hits AS (SELECT {prefixed}, w.pass_no, w.n, w.pos, 0 AS kind, w.candidate, i.* EXCLUDE (key, place, rn), 'arabic' AS matched_on "
        "FROM cands w JOIN arabic_index i ON w.key = i.key), "
        f"latin_hits AS (SELECT {prefixed}, w.pass_no, w.n, w.pos, 1 AS kind, i.place AS candidate, i.* EXCLUDE (key, place, rn), 'latin' AS matched_on "
        "FROM windows w JOIN latin_index i ON contains(lower(w.w), i.key))"
    )


def sql_first(source: str, ids: str) -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {ids}, dialect_term_latin ORDER BY pass_no, n, pos, kind, candidate, entry_no) AS first_rank FROM {source}"
    )


OUT = ["pass_no", "n", "pos", "entry_no", "dialect_term_latin", "matched_on"]

QUERIES["lexicon_key_indexes"] = lambda spark, sf: _indexes(spark, sf)


def _indexes(spark, sf):
    """Dictionary keys next to how many documents name each of them, so that
    the result depends on the tables."""
    lx = lexicon(spark)
    both = lex.key_index(lx, "latin").select(F.lit("latin").alias("kind"), "key", "entry_no").unionByName(
        lex.key_index(lx, "arabic").select(F.lit("arabic").alias("kind"), "key", "entry_no"))
    hits = lex.latin_hits(read(spark, sf, "documents"), lx, ["doc_id"])
    per_entry = hits.groupBy("entry_no").agg(F.count("*").alias("n_docs"))
    return both.join(per_entry, "entry_no", "left").na.fill(0, ["n_docs"])


SQL["lexicon_key_indexes"] = (
    f"WITH {LEXICON}, {SQL_INDEX}, hits AS (SELECT i.entry_no, count(*) AS n_docs FROM documents d JOIN latin_index i "
    f"ON contains(lower(d.text), i.key) OR contains(lower(array_to_string({TOKENS}, ' ')), i.key) GROUP BY 1) "
    "SELECT b.kind, b.key, b.entry_no, coalesce(n_docs, 0) AS n_docs FROM "
    "(SELECT 'latin' AS kind, key, entry_no FROM latin_index UNION ALL SELECT 'arabic', key, entry_no FROM arabic_index) b "
    "LEFT JOIN hits USING (entry_no)"
)

QUERIES["arabic_lexicon_match"] = lambda spark, sf: lex.arabic_hits(
    messages(spark, sf), lexicon(spark), ID).select(*ID, "pass_no", "n", "pos", "candidate", "entry_no")
SQL["arabic_lexicon_match"] = (
    f"WITH {MESSAGES}, {LEXICON}, {SQL_INDEX}, {sql_windows('messages', 'conv_id, turn')}, {sql_hits('conv_id, turn')} "
    "SELECT conv_id, turn, pass_no, n, pos, candidate, entry_no FROM arabic_hits"
)
QUERIES["latin_lexicon_match"] = lambda spark, sf: lex.latin_hits(
    read(spark, sf, "documents"), lexicon(spark), ["doc_id"]).select("doc_id", "pass_no", "n", "pos", "entry_no")
SQL["latin_lexicon_match"] = (
    f"WITH {LEXICON}, {SQL_INDEX}, {sql_windows('documents', 'doc_id')}, {sql_hits('doc_id')}, "
    "firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entry_no ORDER BY pass_no, n, pos) AS r FROM latin_hits) "
    "SELECT doc_id, pass_no, n, pos, entry_no FROM firsts WHERE r = 1"
)
EXTRACT_CTES = (
    f"{MESSAGES}, {LEXICON}, {SQL_INDEX}, {sql_windows('messages', 'conv_id, turn')}, {sql_hits('conv_id, turn')}, "
    "hits AS (SELECT * FROM arabic_hits UNION ALL SELECT * FROM latin_hits), "
    f"symptoms AS (SELECT * FROM ({sql_first('hits', 'conv_id, turn')}) WHERE first_rank = 1)"
)
QUERIES["symptom_extraction"] = lambda spark, sf: lex.extract_symptoms(
    messages(spark, sf), lexicon(spark), ID).select(*ID, *OUT)
SQL["symptom_extraction"] = f"WITH {EXTRACT_CTES} SELECT conv_id, turn, {', '.join(OUT)} FROM symptoms"

QUERIES["document_symptoms"] = lambda spark, sf: lex.extract_symptoms(
    read(spark, sf, "documents"), lexicon(spark), ["doc_id"]).select("doc_id", *OUT)
SQL["document_symptoms"] = (
    f"WITH {LEXICON}, {SQL_INDEX}, {sql_windows('documents', 'doc_id')}, {sql_hits('doc_id')}, "
    "hits AS (SELECT * FROM arabic_hits UNION ALL SELECT * FROM latin_hits) "
    f"SELECT doc_id, {', '.join(OUT)} FROM ({sql_first('hits', 'doc_id')}) WHERE first_rank = 1"
)


def labels(spark, sf):
    df = messages(spark, sf)
    symptoms = lex.symptom_array(lexicon(spark), F.col("text"))
    with_symptoms = df.select(*ID, "text", symptoms.alias("symptoms"))
    return with_symptoms.select(
        *ID, F.size("symptoms").alias("n_symptoms"), lex.labels_text(F.col("symptoms"), F.col("text")).alias("labels"))


SYMPTOM_LISTS = (
    "sym AS (SELECT m.conv_id, m.turn, m.text, count(s.entry_no) AS n_symptoms, "
    "coalesce(bool_or(s.severity_hint IN (" + ", ".join(q(c) for c in fv.CRITICAL_SEVERITIES) + ")), FALSE) AS critical, "
    "coalesce(nullif(string_agg(nullif(coalesce(nullif(s.english_medical_term, ''), s.msa_equivalent), ''), ', ' "
    "ORDER BY s.pass_no, s.n, s.pos, s.kind, s.candidate, s.entry_no), ''), m.text) AS labels "
    "FROM messages m LEFT JOIN symptoms s USING (conv_id, turn) GROUP BY m.conv_id, m.turn, m.text)"
)
QUERIES["symptom_labels"] = labels
SQL["symptom_labels"] = f"WITH {EXTRACT_CTES}, {SYMPTOM_LISTS} SELECT conv_id, turn, n_symptoms, labels FROM sym"


def rule_levels(spark, sf):
    matches = lex.extract_symptoms(messages(spark, sf), lexicon(spark), ID)
    gathered = lex.gather(matches, ID)
    return (
        messages(spark, sf).select(*ID).join(gathered, ID, "left")
        .select(*ID, F.when(F.col("symptoms").isNull(), "YELLOW").otherwise(lex.rule_level(F.col("symptoms"))).alias("level"))
    )


QUERIES["rule_only_level"] = rule_levels
SQL["rule_only_level"] = (
    f"WITH {EXTRACT_CTES}, {SYMPTOM_LISTS} SELECT conv_id, turn, CASE WHEN critical THEN 'RED' ELSE 'YELLOW' END AS level FROM sym"
)
