"""The queries of this package, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symptia.llm import byte_bpe, chat, exact_dedup, langid, neighbours, ngram_lm, packing, pii, ranked_search, repeats, repetition, simhash, vector_codes
from symptia.llm.common import read


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encoding_digests(
        read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digests(read(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.windows(chat.with_control(read(spark, sf_dir, "conversations"))))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs).select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(read(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_pack, op2_byte_bpe, op3_pii, op4_repeats, op5_neighbours, op6_chat, op7_simhash, op8_exact_dedup, op9_kneser_ney,
    op10_langid, op11_ranked_search, op12_repetition, op13_vector_codes)}

# Words of windows of ``size`` that occur twice or more in their text.
_IN_WINDOWS = """(
            SELECT doc, count(DISTINCT first + step) AS covered
            FROM (SELECT doc, unnest(places) AS first FROM (
                    SELECT doc, list(place) AS places
                    FROM (SELECT doc, generate_subscripts(words, 1) AS place, words FROM split)
                    WHERE place + {size} - 1 <= len(words)
                    GROUP BY doc, words[place : place + {size} - 1] HAVING count(*) > 1)),
                 (SELECT unnest(range({size})) AS step)
            GROUP BY doc)"""



def _codes_sql() -> str:
    """Integer k-means written out: an assignment and a codebook a round."""
    steps = [f"""
        kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
            SELECT r, part, v[part * (len(v) // {vector_codes.PARTS}) + 1 : (part + 1) * (len(v) // {vector_codes.PARTS})] AS x
            FROM kept, (SELECT unnest(range({vector_codes.PARTS})) AS part)),
        book0 AS MATERIALIZED (
            SELECT part, entry, x AS c
            FROM (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM kept) JOIN parts USING (r)
            WHERE entry < {vector_codes.ENTRIES})"""]
    for number in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
        near{number} AS MATERIALIZED (
            SELECT r, part, min([d, entry]) AS best
            FROM (SELECT r, part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
                  FROM parts JOIN book{number} USING (part))
            GROUP BY r, part)""")
        if number < vector_codes.ROUNDS:
            steps.append(f"""
        means{number} AS (
            SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY place) AS m
            FROM (SELECT part, best[2] AS entry, place, sum(CAST(x[place] AS DOUBLE)) AS s, count(*) AS n
                  FROM (SELECT part, best, x, unnest(generate_series(1, len(x))) AS place
                        FROM near{number} JOIN parts USING (r, part))
                  GROUP BY ALL)
            GROUP BY part, entry),
        book{number + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(m, c) AS c FROM book{number} LEFT JOIN means{number} USING (part, entry))""")
    last = vector_codes.ROUNDS
    return f"""
        WITH {",".join(steps)},
        coded AS (
            SELECT r, string_agg(printf('%02x', CAST(best[2] AS INTEGER)), '' ORDER BY part) AS code,
                   CAST(sum(best[1]) AS BIGINT) AS error
            FROM near{last} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(c[place] AS VARCHAR), ',' ORDER BY part, entry, place))
                FROM (SELECT part, entry, c, unnest(generate_series(1, len(c))) AS place FROM book{last})) AS codebooks_sha256
        FROM kept JOIN coded USING (r)"""


SQL = {
    "op11_ranked_search": r"""
        WITH words AS (
            SELECT row_number() OVER () AS doc, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        asked AS (
            SELECT DISTINCT item, item_id, unnest(regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT *, row_number() OVER () AS item FROM benchmark)),
        totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM words),
        counts AS (SELECT doc, doc_id, size, term, count(*) AS tf
                   FROM (SELECT doc, doc_id, len(terms) AS size, unnest(terms) AS term FROM words)
                   WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w
                    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
        scored AS (
            SELECT item, item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * n) // l))))::BIGINT AS score
            FROM asked JOIN counts USING (term) JOIN weights USING (term), totals
            GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
                   FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_vector_codes": _codes_sql(),
    "op12_repetition": f"""
        WITH split AS (
            SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        three AS {_IN_WINDOWS.format(size=repetition.WINDOW)},
        passages AS {_IN_WINDOWS.format(size=repetition.LEAST)},
        longer AS {_IN_WINDOWS.format(size=repetition.LONGEST + 1)},
        counted AS (
            SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   (SELECT count(*) - count(DISTINCT line) FROM (SELECT unnest(string_split(s.text, chr(10))) AS line)
                    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_dup_lines,
                   coalesce(three.covered, 0) AS n_repeat_words, coalesce(passages.covered, 0) AS covered_words,
                   longer.doc IS NOT NULL AS long_repeat
            FROM split s LEFT JOIN three USING (doc) LEFT JOIN passages USING (doc) LEFT JOIN longer USING (doc)),
        judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND covered_words <= {repetition.COVERED} * n_words AND NOT long_repeat AS kept, covered_words
        FROM judged""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
              FROM documents)
        WINDOW g AS (PARTITION BY t)""",
}

# All that op6_chat returns but the length of the windows: the tests compare it.
CHAT_SQL = """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
             c AS (SELECT conv_id, count(*) AS n_turns,
                          string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
                          coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                                   FILTER (WHERE role = 'assistant'), '') AS lost
                   FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256
        FROM c"""
