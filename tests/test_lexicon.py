import random
import re

import numpy as np
import pytest
from checks.inputs import LEXICON_COLUMNS, LEXICON_ROWS, USER_PHRASES, lexicon
from pyspark.sql import functions as F
from symptia.functions import text
from symptia.operators import lexicon as lex
from symptia.operators import trie

TEXTS = [*USER_PHRASES, "", "waja3 waja3", "grass", "عِنْدِي وَجَع، راس!", "3andi3 وجع", "وجع abcdefgh", "no coffee, thanks", "ktef  7arara", "دم"]


def brute_force(normalize, language, value):
    """First hits by trying every window against every entry."""
    latin, arabic = {}, {}
    for i, row in enumerate(LEXICON_ROWS):
        if row[1].lower().strip():
            latin[row[1].lower().strip()] = i
        if normalize[row[0]]:
            arabic[normalize[row[0]]] = i
    tokens = re.findall("[؀-ۿ]+|[a-zA-Z0-9]+", value)
    windows = [" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)] + [value]
    seen = {}
    for w in windows:
        hits = []
        if language[w] in ("arabic", "franco_arab"):
            hits += [(arabic[c], "arabic") for c in [normalize[w], *normalize[w].split()] if c in arabic]
        hits += [(e, "latin") for k, e in latin.items() if k in w.lower()]
        for e, side in hits:
            seen.setdefault(LEXICON_ROWS[e][1], (e, side))
    return sorted((k, *v) for k, v in seen.items())


def windows_of(value):
    tokens = re.findall("[؀-ۿ]+|[a-zA-Z0-9]+", value)
    return [" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)] + [value]


def test_extraction_matches_brute_force(spark, texts):
    every = sorted({w for v in TEXTS for w in windows_of(v)} | {r[0] for r in LEXICON_ROWS})
    facts = texts(*every).select("text", text.normalize("text").alias("n"), text.detect_language("text").alias("l")).collect()
    normalize, language = {r.text: r.n for r in facts}, {r.text: r.l for r in facts}
    want = {i: brute_force(normalize, language, v) for i, v in enumerate(TEXTS)}
    df, entries = texts(*TEXTS), lexicon(spark)
    joined = lex.extract_symptoms(df, entries, ["id"])
    descended = lex.extract_symptoms(df, entries, ["id"], literal_entries=0)
    inside = df.select("id", F.explode(lex.symptom_array(entries, F.col("text"))).alias("m")).select("id", "m.*")
    for got in (joined, descended, inside):
        rows = {i: [] for i in want}
        for r in got.collect():
            rows[r.id].append((r.dialect_term_latin, r.entry_no, r.matched_on))
        assert {i: sorted(v) for i, v in rows.items()} == want


def test_order_and_labels(spark, texts):
    symptoms = lex.symptom_array(lexicon(spark), F.col("text"))
    df = texts("3andi waj3it ras w dawkha", "nothing here").select("id", "text", symptoms.alias("s")).orderBy("id")
    a, b = df.select(lex.labels_text(F.col("s"), F.col("text")).alias("l"), lex.rule_level(F.col("s")).alias("v")).collect()
    assert (a.l, a.v) == ("head, vertigo, head ache", "YELLOW")
    assert (b.l, b.v) == ("nothing here", "YELLOW")


def test_load_lexicon(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"entries": [{"dialect_term": "دم", "dialect_term_latin": "dam"}, {"dialect_term_latin": "DAM ", "category": "x"}]}', encoding="utf-8")
    loaded = lex.load_lexicon(spark, str(tmp_path / "d.json"))
    assert set(LEXICON_COLUMNS) <= set(loaded.columns)
    index = lex.key_index(loaded, "latin").collect()
    assert [(r.key, r.entry_no, r.place, r.category) for r in index] == [("dam", 1, 0, "x")]


def test_terms_in_latin_letters_match_on_the_dialect_side(spark, texts):
    rows = [(0, "waja3", "", "ألم", "ache", "c", "s", "mild"), (1, "وجع", "", "ألم", "ache", "c", "s", "mild")]
    entries = spark.createDataFrame(rows, "entry_no int, " + ", ".join(f"{c} string" for c in lex.FIELDS))
    df = texts("3andi waja3", "waja3", "plain words", "عندي وجع")
    hits = {(r.id, r.entry_no) for r in lex.arabic_hits(df, entries, ["id"]).collect()}
    assert hits == {(0, 0), (1, 0), (3, 1)}
    inside = df.select("id", lex.symptom_array(entries, F.col("text")).alias("s")).collect()
    assert {(r.id, m.entry_no) for r in inside for m in r.s} == hits


def word(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))


def test_descent_finds_every_occurrence(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(trie, "PLACES", 64)
    for letters in ("ab", "ab c", "aé\U0001f600 \0"):
        keys = sorted({word(rng, letters, 7) for _ in range(40)})
        values = ["", *[word(rng, letters, 90) for _ in range(20)], "", keys[-1]]
        codes, starts = trie.characters(values)
        places, terms = (np.concatenate(c) for c in zip(*trie.descend(codes, trie.build(keys))))
        got = sorted(zip(places.tolist(), terms.tolist()))
        want = [(starts[v] + i, k) for v, value in enumerate(values) for i in range(len(value))
                for k, key in enumerate(keys) if value.startswith(key, i)]
        assert got == sorted(want)
        first = {(v, k): value[: value.index(key)].count(" ") for v, value in enumerate(values) for k, key in enumerate(keys) if key in value}
        assert {(v, k): b for v, k, b in zip(*(c.tolist() for c in trie.firsts(values, trie.build(keys), len(keys))))} == first


@pytest.mark.parametrize("entries, characters", [(20, 4_000_000), (2_001, 4_000_000), (2_001, 3_000)])
def test_tries_and_literals_find_the_same(spark, monkeypatch, entries, characters):
    """Terms of one to five tokens, also such that only the text as it stands
    holds; a NULL and an empty text; one trie and several."""
    rng = random.Random(entries)
    monkeypatch.setattr(trie, "TRIE_CHARACTERS", characters)
    monkeypatch.setattr(lex, "LITERAL_KEYS", 10_000)
    vocabulary = [word(rng, "abcdefg3", 5) for _ in range(60)]
    phrases = ["a, b", "a  b c d e", *[" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))) for _ in range(entries)]]
    rows = [(i, "", p, "", p, "c", "s", "mild") for i, p in enumerate(phrases)]
    dictionary = spark.createDataFrame(rows, "entry_no int, " + ", ".join(f"{c} string" for c in lex.FIELDS))
    values = [None, "", "A, B", "x a  b c d e", *[rng.choice([" ", ", ", "  "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(30))) for _ in range(40)]]
    df = spark.createDataFrame([(None if i == 3 else i, v) for i, v in enumerate(values)], "id int, text string").repartition(3)
    literal = lex.latin_hits(df, dictionary, ["id"], literal_entries=10_000)
    descended = lex.latin_hits(df, dictionary, ["id"], literal_entries=0)
    assert descended.schema.simpleString() == literal.schema.simpleString()
    want = sorted(map(str, literal.collect()))
    assert len(want) > 40 and sorted(map(str, descended.collect())) == want


def exchanged(plan):
    """Names of the columns that the exchanges of a plan carry."""
    own = [plan.output().apply(i).name() for i in range(plan.output().size())] if "Exchange" in plan.nodeName() else []
    return set(own).union(*[exchanged(plan.children().apply(i)) for i in range(plan.children().size())])


def test_no_text_is_shuffled(spark, texts, monkeypatch):
    monkeypatch.setattr(lex, "broadcast_if_small", lambda df: df)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = lex.latin_hits(texts(*TEXTS), lexicon(spark), ["id"], literal_entries=0)
        carried = exchanged(hits._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {"id", "key", "pass_no"} <= carried and carried.isdisjoint({"text", "_joined", "_lowered"})


def test_empty_dictionary(spark, texts):
    none = lexicon(spark).limit(0)
    assert lex.latin_hits(texts(*TEXTS), none, ["id"], literal_entries=0).count() == 0
