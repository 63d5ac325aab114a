"""Dictionary matching of symptom terms.

A term matches in two ways. Arabic: the normalised window, or one of its
tokens, equals a normalised term, provided the window reads as Arabic or
Latin-letter Arabic. Latin: the lower-cased term is a substring of the
lower-cased window. Windows are runs of one, two and three tokens, and finally
the whole text; per Latin name the first hit counts.

No n-gram is materialised for the Latin side: a term with c inner blanks first
shows up in a window of c+1 tokens, at the token in which its first occurrence
in the joined tokens starts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import text
from symptia.functions.rows import explode_rows
from symptia.operators import trie
from symptia.session import broadcast_if_small

# Dictionaries become a literal in the plan up to this many keys, those of both
# sides counted; larger ones are joined. The rows are the same either way.
LITERAL_KEYS = 2_000
MAX_WINDOW = 3
FIELDS = [
    "dialect_term", "dialect_term_latin", "msa_equivalent", "english_medical_term",
    "category", "body_system", "severity_hint",
]
ORDER = ["pass_no", "n", "pos", "kind", "candidate", "entry_no"]


# -------------------------------------------------------------------- indexes
def key_index(lexicon: DataFrame, kind: str) -> DataFrame:
    """One row per key; of entries sharing a key the last one is kept, while
    its place in the order is that of the first."""
    key = (
        text.strip(F.lower("dialect_term_latin"))
        if kind == "latin"
        else text.normalize("dialect_term")
    )
    whole = F.struct("entry_no", *FIELDS)
    return (
        lexicon.na.fill("", FIELDS)
        .withColumn("key", key)
        .filter(F.col("key") != "")
        .groupBy("key")
        .agg(F.max_by(whole, "entry_no").alias("entry"), F.min("entry_no").alias("place"))
        .select("key", "place", "entry.*")
    )


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a dictionary file ``{"entries": [...]}`` with their position.
    The file is a single JSON value, so it is read as one row and exploded."""
    entry = "struct<" + ",".join(f"{c}:string" for c in FIELDS) + ">"
    return (
        spark.read.schema(f"entries array<{entry}>")
        .option("multiLine", True)
        .json(path)
        .select(F.posexplode("entries").alias("entry_no", "e"))
        .select("entry_no", "e.*")
        .na.fill("", FIELDS)
    )


def _small_rows(index: DataFrame) -> list | None:
    """The index as driver rows if it is small, else None."""
    rows = index.orderBy("place").limit(LITERAL_KEYS + 1).collect()
    return rows if len(rows) <= LITERAL_KEYS else None


def _literal(rows: list) -> Column:
    """Index rows as one array literal; the optimizer folds the JSON away."""
    columns = ["key", "place", "entry_no", *FIELDS]
    schema = "key:string,place:int,entry_no:int," + ",".join(f"{c}:string" for c in FIELDS)
    content = json.dumps([{c: r[c] for c in columns} for r in rows], ensure_ascii=False)
    return F.from_json(F.lit(content), f"array<struct<{schema}>>")


# ------------------------------------------------------------------- windows
def window_tokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("_tokens", text.symptom_tokens(text_col))


def _arabic_windows(tokens: Column, whole: Column) -> Column:
    """Structs (pass_no, n, pos, w) of the windows that read as Arabic or as
    Latin-letter Arabic. A text with neither Arabic characters nor the digits
    that stand for Arabic letters has none (NULL), which spares it the work."""

    def of(n: int) -> Column:
        return F.transform(
            text.ngrams(tokens, n),
            lambda w, i: F.struct(
                F.lit(1).alias("pass_no"), F.lit(n).alias("n"), i.alias("pos"), w.alias("w")
            ),
        )

    last = F.array(
        F.struct(F.lit(2).alias("pass_no"), F.lit(0).alias("n"), F.lit(0).alias("pos"), whole.alias("w"))
    )
    every = F.concat(*[of(n) for n in range(1, MAX_WINDOW + 1)], last)
    # most windows of a mixed text are plain Latin: the cheap test spares them the full one
    readable = F.filter(every, lambda s: _may_be_arabic(s["w"]) & text.detect_language(s["w"]).isin("arabic", "franco_arab"))
    return F.when(_may_be_arabic(whole), readable)


def _may_be_arabic(whole: Column) -> Column:
    return whole.rlike(f"[{fv.ARABIC_BLOCK}]") | (whole.rlike(fv.FRANCO_DIGITS) & whole.rlike("[a-zA-Z]"))


def arabic_hits(df: DataFrame, lexicon: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Arabic-side hits: exploded candidates joined to the index on equality.
    A term may be written in any letters. The index is broadcast when small.
    """
    index = key_index(lexicon, "arabic")
    windows = (
        df.filter(_may_be_arabic(F.col(text_col)))
        .select(*id_cols, F.col(text_col).alias("_text"), text.symptom_tokens(text_col).alias("_tokens"))
    )
    windows = explode_rows(windows, id_cols, _arabic_windows(F.col("_tokens"), F.col("_text")), "s").select(
        *id_cols, "s.pass_no", "s.n", "s.pos", text.normalize("s.w").alias("_norm")
    )
    candidates = explode_rows(
        windows, [*id_cols, "pass_no", "n", "pos"], F.concat(F.array("_norm"), text.words("_norm")), "key", "candidate"
    )
    return (
        candidates.join(broadcast_if_small(index), "key")
        .withColumn("kind", F.lit(0))
        .withColumn("matched_on", F.lit("arabic"))
        .drop("key", "place")
    )


def _latin_position(key: Column, blanks: Column, joined: Column, lowered: Column) -> Column:
    """Struct (pass_no, n, pos) of the first hit of a term, NULL without one."""
    at = F.instr(joined, key)
    before = F.substring(joined, F.lit(1), at - 1)
    pos = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    return F.when(
        (at > 0) & (blanks < MAX_WINDOW),
        F.struct(F.lit(1).alias("pass_no"), (blanks + 1).alias("n"), pos.alias("pos")),
    ).when(
        F.contains(lowered, key),
        F.struct(F.lit(2).alias("pass_no"), F.lit(0).alias("n"), F.lit(0).alias("pos")),
    )


def _blanks(key: Column) -> Column:
    return F.length(key) - F.length(F.replace(key, F.lit(" "), F.lit("")))


def latin_hits(
    df: DataFrame, lexicon: DataFrame, id_cols: list[str], text_col: str = "text",
    literal_entries: int = LITERAL_KEYS,
) -> DataFrame:
    """Latin-side hits.

    A small dictionary is a literal array filtered inside each row: no join at
    all. A larger one becomes a trie that every task runs over its texts; only
    ids and terms meet the dictionary's other fields in a join.
    """
    index = key_index(lexicon, "latin")
    base = df.select(
        *id_cols,
        F.lower(text_col).alias("_lowered"),
        F.lower(F.array_join(text.symptom_tokens(text_col), " ")).alias("_joined"),
    )
    rows = _small_rows(index) if literal_entries else None
    if rows is not None and len(rows) <= literal_entries:
        entries = _literal(rows)
        hits = F.filter(
            entries, lambda e: F.contains(F.col("_lowered"), e["key"]) | F.contains(F.col("_joined"), e["key"])
        )
        joined = explode_rows(base, [*id_cols, "_lowered", "_joined"], hits, "_e").select(
            *id_cols, "_lowered", "_joined", "_e.*"
        )
        joined = joined.withColumn(
            "_p", _latin_position(F.col("key"), _blanks(F.col("key")), F.col("_joined"), F.col("_lowered"))
        ).filter(F.col("_p").isNotNull())
    else:
        found = trie.found_terms(index, F.col("_joined"), F.col("_lowered"), MAX_WINDOW)
        hits = explode_rows(base, id_cols, found, "_e").select(*id_cols, "_e.*")
        joined = hits.join(broadcast_if_small(index), "key").select(
            *id_cols, F.struct("pass_no", "n", "pos").alias("_p"), "place", "entry_no", *FIELDS)
    return joined.select(
        *id_cols, "_p.pass_no", "_p.n", "_p.pos", F.lit(1).alias("kind"), F.col("place").alias("candidate"),
        "entry_no", *FIELDS, F.lit("latin").alias("matched_on"),
    )


def extract_symptoms(
    df: DataFrame, lexicon: DataFrame, id_cols: list[str], text_col: str = "text",
    literal_entries: int = LITERAL_KEYS,
) -> DataFrame:
    """One row per text and Latin name: its first hit.

    ``min_by`` combines on the map side, so a text or a name with very many
    hits never gathers in one task.
    """
    arabic = arabic_hits(df, lexicon, id_cols, text_col)
    latin = latin_hits(df, lexicon, id_cols, text_col, literal_entries)
    order = F.struct(*ORDER)
    hits = arabic.unionByName(latin)
    first = hits.groupBy(*id_cols, F.col("dialect_term_latin").alias("_name")).agg(
        F.min_by(F.struct(*ORDER, *[c for c in FIELDS], "matched_on"), order).alias("m")
    )
    return first.select(*id_cols, "m.*")


# ---------------------------------------------------- symptoms inside one row
def symptom_array(lexicon: DataFrame, text_col: Column) -> Column | None:
    """The matches of :func:`extract_symptoms` as an array column, computed
    within the row: no join and no shuffle. None when the dictionary is too
    large to be a literal."""
    both = key_index(lexicon, "latin").withColumn("side", F.lit("latin")).unionByName(
        key_index(lexicon, "arabic").withColumn("side", F.lit("arabic")))
    rows = _small_rows(both)
    if rows is None:
        return None
    latin, arabic = ([r for r in rows if r["side"] == s] for s in ("latin", "arabic"))
    def found(e: Column, kind: int, pass_no: Column, n: Column, pos: Column, candidate: Column, label: str) -> Column:
        return F.struct(
            pass_no.cast("int").alias("pass_no"), n.cast("int").alias("n"), pos.cast("int").alias("pos"),
            F.lit(kind).alias("kind"), candidate.cast("int").alias("candidate"), e["entry_no"].alias("entry_no"),
            *[e[c].alias(c) for c in FIELDS], F.lit(label).alias("matched_on"),
        )

    lowered = F.lower(text_col)

    def latin_found(joined: Column) -> Column:
        def hit(e: Column) -> Column:
            p = _latin_position(e["key"], _blanks(e["key"]), joined, lowered)
            return text.bind(p, lambda v: F.when(
                v.isNotNull(), found(e, 1, v["pass_no"], v["n"], v["pos"], e["place"], "latin")))

        return F.filter(F.transform(_literal(latin), hit), lambda m: m.isNotNull())

    def arabic_found(tokens: Column) -> Column:
        windows = F.transform(
            _arabic_windows(tokens, text_col),
            lambda s: F.struct(s["pass_no"], s["n"], s["pos"], text.bind(
                text.normalize(s["w"]), lambda w: F.concat(F.array(w), text.words(w))).alias("c")),
        )

        def hit(e: Column, ws: Column) -> Column:
            first = F.filter(ws, lambda s: F.array_contains(s["c"], e["key"]))
            return text.bind(F.try_element_at(first, F.lit(1)), lambda s: F.when(
                s.isNotNull(),
                found(e, 0, s["pass_no"], s["n"], s["pos"], F.array_position(s["c"], e["key"]) - 1, "arabic")))

        return text.bind(windows, lambda ws: F.filter(
            F.transform(_literal(arabic), lambda e: hit(e, ws)), lambda m: m.isNotNull()))

    tokens = text.symptom_tokens(text_col)
    every = text.bind(tokens, lambda t: F.array_sort(F.concat(
        arabic_found(t),
        text.bind(F.lower(F.array_join(t, " ")), latin_found))))
    return text.bind(every, lambda ms: F.filter(ms, lambda m, i: ~F.exists(
        F.slice(ms, F.lit(1), i), lambda o: o["dialect_term_latin"] == m["dialect_term_latin"])))


# --------------------------------------------------------------- derivations
def labels_text(symptoms: Column, query: Column) -> Column:
    """English names (or the standard Arabic ones), comma separated, else the
    query itself."""
    labels = F.filter(
        F.transform(symptoms, lambda m: F.coalesce(F.nullif(m["english_medical_term"], F.lit("")), m["msa_equivalent"])),
        lambda s: s != "",
    )
    return F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise(query)


def rule_level(symptoms: Column, critical: list[str] = fv.CRITICAL_SEVERITIES) -> Column:
    return F.when(F.exists(symptoms, lambda m: m["severity_hint"].isin(critical)), "RED").otherwise("YELLOW")


def gather(matches: DataFrame, id_cols: list[str]) -> DataFrame:
    """Matches of a text as one ordered array; at most one per Latin name."""
    return matches.groupBy(*id_cols).agg(
        F.array_sort(F.collect_list(F.struct(*ORDER, *FIELDS, "matched_on"))).alias("symptoms")
    )
