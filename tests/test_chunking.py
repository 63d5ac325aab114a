import json

import pytest
from pyspark.sql import functions as F

from symptia.functions import text
from symptia.operators import chunking
from symptia.plans import ingest
from symptia.sources import corpus
from symptia.streaming import jobs, runner

SAMPLE = "# Heart\n\nFirst part of it.\n## Signs\nPain and more pain, daily.\nSUDDEN CHANGES\nCall someone.\n" * 6


def pages(spark, *values):
    return spark.createDataFrame([(f"heart_{i}.md", 0, v) for i, v in enumerate(values)], "source_name string, page_number int, text string")


@pytest.mark.parametrize("chunk, overlap", [(20, 5), (7, 0), (5, 9), (500, 50)])
def test_windows_cover_the_text(spark, chunk, overlap):
    df = pages(spark, SAMPLE).select(text.pieces("text").alias("p"), F.explode(chunking.chunk_spans(text.pieces("text"), chunk, overlap)).alias("w"))
    rows = sorted(df.collect(), key=lambda r: r.w.idx)
    p, step = rows[0].p, max(chunk - overlap, 1)
    assert [r.w.idx for r in rows] == list(range(-(-len(p) // step)))
    for r in rows:
        assert r.w.raw == "".join(p[r.w.idx * step : r.w.idx * step + chunk]) == SAMPLE[r.w.char_start : r.w.char_end]
    assert rows[-1].w.char_end == len(SAMPLE)


def test_trailing_window_is_kept(spark):
    words = pages(spark, " ".join(["ab"] * 460))
    assert chunking.chunk_pages(words, 500, 50).count() == 2


def test_chunk_fields(spark):
    rows = chunking.chunk_pages(pages(spark, SAMPLE, "   \n", "plain words only"), 12, 2).orderBy("source_name", "char_start").collect()
    assert {r.source_name for r in rows} == {"heart_0.md", "heart_2.md"}
    first = rows[0]
    assert (first.chunk_id, first.section_title, first.medical_category, first.char_start) == ("heart_0_0_0", "Heart", "cardiovascular", 0)
    titles = {r.section_title for r in rows if r.source_name == "heart_0.md"}
    assert titles == {"Heart", "Signs", "SUDDEN CHANGES"}
    assert rows[-1].section_title == ""
    for r in rows:
        assert r.text == r.text.strip() and r.token_count > 0


def test_sections_are_as_of_the_start(spark):
    rows = pages(spark, "intro\n# One\nx\n#Two\n## Three  \ny").select(chunking.section_headings(F.col("text")).alias("h")).collect()
    assert [(h.start, h.title) for h in rows[0].h] == [(6, "One"), (19, "Three")]
    headings = F.array(F.struct(F.lit(6).alias("start"), F.lit("One").alias("title")))
    got = pages(spark, "x").select(*[chunking.section_at(headings, F.lit(o)) for o in (5, 6, 7)]).collect()[0]
    assert list(got) == ["", "One", "One"]


@pytest.mark.parametrize("block, levels", [(64, 2), (3, 2), (2, 1), (64, 0)])
def test_sums_before(spark, monkeypatch, block, levels):
    monkeypatch.setattr(chunking, "BLOCK", block)
    sizes = [0, 1, 2, 3, 63, 64, 65, 200]
    df = spark.createDataFrame([(n, [(7 * i) % 11 for i in range(n)]) for n in sizes], "n int, v array<int>")
    got = df.select("n", "v", chunking.sums_before(F.col("v"), levels).alias("s")).collect()
    assert len(got) == len(sizes)
    for r in got:
        assert r.s == [sum(r.v[:i]) for i in range(r.n)]


def test_sections_by_bisection(spark):
    for n in (0, 1, 2, 7, 8):
        headings = F.array(*[F.struct(F.lit(5 * i + 2).alias("start"), F.lit(f"t{i}").alias("title")) for i in range(n)]).cast(
            "array<struct<start:int,title:string>>")
        got = spark.range(45).select("id", chunking.section_at(headings, F.col("id").cast("int")).alias("t")).collect()
        assert all(r.t == next((f"t{i}" for i in reversed(range(n)) if 5 * i + 2 <= r.id), "") for r in got)


def test_corpus_scan_and_sinks(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "a_lung.txt").write_text("one\n\ntwo", encoding="utf-8")
    (src / "b.md").write_bytes(b"caf\xe9 # x")
    (src / "c.pdf").write_bytes(b"x")
    (src / "sub" / "d.txt").write_text("hidden", encoding="utf-8")
    found = corpus.scan_corpus(spark, str(src))
    assert {r.source_name: r.text for r in found.collect()} == {"a_lung.txt": "one\n\ntwo", "b.md": "caf� # x"}
    chunks, rejected = ingest.ingest(found)
    manifest = corpus.write_chunks(chunks, found, str(src), str(tmp_path / "out")).collect()[0]
    assert (manifest.files_processed, manifest.total_chunks, manifest.encoding) == (2, 2, "cl100k_base")
    assert rejected.count() == 0
    streamed = runner.append(jobs.ingest_stream(runner.read_corpus(spark, str(src))), "ingest", str(tmp_path / "stream"))
    assert sorted(r.chunk_id for r in streamed.collect()) == ["a_lung_0_0", "b_0_0"]


def test_nested_files(spark, tmp_path):
    chunk = {"chunk_id": "x_0_0", "source_name": "x.md", "page_number": 0, "section_title": "S", "medical_category": "general",
             "text": "t", "token_count": 1, "char_start": 0, "char_end": 1}
    (tmp_path / "chunks.json").write_text(json.dumps({"metadata": {"encoding": "e"}, "chunks": [chunk, chunk]}, indent=2))
    assert corpus.scan_envelopes(spark, str(tmp_path / "chunks.json")).count() == 2
    scenario = {"id": "r1", "input_text": "وجع", "input_type": "arabic", "expected_triage_level": "RED", "should_escalate": True}
    (tmp_path / "s.json").write_text(json.dumps({"scenarios": [scenario]}, ensure_ascii=False), encoding="utf-8")
    row = corpus.scan_scenarios(spark, str(tmp_path / "s.json")).collect()[0]
    assert (row.input_text, row.should_escalate, row.notes) == ("وجع", True, None)


def test_nested_documents_share_files(spark, tmp_path):
    """As many files as tasks, however many sources."""
    pages = spark.createDataFrame([(f"{i}.txt", 0, f"# Part {i}\none two") for i in range(200)], "source_name string, page_number int, text string")
    chunks = chunking.chunk_pages(pages)
    folder = str(tmp_path / "nested")
    corpus.write_envelopes(chunks.coalesce(1), folder)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(list((tmp_path / "nested").rglob("*.txt"))) <= tasks
    back = corpus.scan_envelopes(spark, folder, lines=True)
    assert set(back.select("encoding").distinct().toPandas()["encoding"]) == {"cl100k_base"}
    assert sorted(map(tuple, back.select(*chunks.columns).collect())) == sorted(map(tuple, chunks.collect()))


def test_names_of_files_need_no_content(spark, tmp_path):
    for name in ("a.txt", "b.md", "c.pdf"):
        (tmp_path / name).write_text("x")
    names = corpus.scan_corpus(spark, str(tmp_path)).select("source_name")
    assert sorted(r.source_name for r in names.collect()) == ["a.txt", "b.md"]
    scan = names._jdf.queryExecution().executedPlan().toString()
    assert "FileScan binaryFile" in scan and "content" not in scan


def test_micro_batches_do_not_grow_with_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(600):
        (source / f"f{i}.txt").write_text(f"text {i}")
    out = runner.append(jobs.ingest_stream(runner.read_corpus(spark, str(source))), "many", str(tmp_path / "out"), settings=runner.SMALL_FILES)
    assert out.select("chunk_id").distinct().count() == 600
    assert len(list((tmp_path / "out" / "checkpoint" / "commits").glob("[0-9]*"))) == 1


def test_failures_are_rows(spark):
    df = spark.createDataFrame([("a.txt", 0, "ok"), ("b.docx", 0, "x"), ("c.md", 0, None)], "source_name string, page_number int, text string")
    valid, rejected = corpus.split_readable(df)
    assert [r.source_name for r in valid.collect()] == ["a.txt"]
    assert {r.error for r in rejected.collect()} == {"b.docx: unsupported file type", "c.md: unreadable"}
    assert list(ingest.totals(df).collect()[0]) == [1, 1, 2]


def test_a_failed_run_leaves_the_version_before(spark, tmp_path):
    """A task that fails, and a stop between chunks and manifest."""

    folder = str(tmp_path / "sink")
    pages = spark.createDataFrame([("a.txt", 0, "one two"), ("b.txt", 0, "three")], "source_name string, page_number int, text string")
    with pytest.raises(FileNotFoundError):
        corpus.read_chunks(spark, folder)
    corpus.write_chunks(chunking.chunk_pages(pages), pages, "x", folder)
    first = sorted(r.text for r in corpus.read_chunks(spark, folder).collect())
    assert first == ["one two", "three"]
    more = pages.withColumn("text", F.concat("text", F.lit(" more")))
    broken = chunking.chunk_pages(more).withColumn("text", F.when(F.col("source_name") == "b.txt", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        corpus.write_chunks(broken, more, "x", folder)
    assert sorted(r.text for r in corpus.read_chunks(spark, folder).collect()) == first
    chunking.chunk_pages(more).write.mode("overwrite").parquet(f"{folder}/version=2/chunks")
    assert sorted(r.text for r in corpus.read_chunks(spark, folder).collect()) == first
    row = corpus.write_chunks(chunking.chunk_pages(more), more, "x", folder).collect()[0]
    assert row.total_chunks == 2 and sorted(r.text for r in corpus.read_chunks(spark, folder).collect()) == ["one two more", "three more"]
