"""Folders of many files: listed and read by tasks, as Spark's readers would."""

import string

import pytest

from symptia.sources import corpus, listing
from symptia.streaming import jobs, runner


@pytest.fixture
def listed(monkeypatch):
    """Every folder is a large one."""
    monkeypatch.setattr(corpus, "LISTED", 0, raising=False)


def rows(df):
    return sorted(map(tuple, df.collect()))


def odd_files(folder):
    (folder / "lower.txt").mkdir(parents=True)
    (folder / "lower.txt" / "inner.txt").write_text("x")
    for name in ("a.txt", "b.md", ".hidden.txt", "_under.txt", "_metadata.txt", "_k=v.md", "c.pdf", "D.TXT", "txt", ".md", "x.y.md"):
        (folder / name).write_text(f"text of {name}")
    (folder / "empty.txt").write_text("")
    (folder / "bad.md").write_bytes(b"caf\xe9 \xf0\x9f\x98 \xed\xa0\x80 # x")
    (folder / "gone.txt").symlink_to(folder / "nothing")
    (folder / "link.txt").symlink_to(folder / "a.txt")


def test_names_of_a_large_folder(spark, tmp_path, monkeypatch):
    """The driver gets a listing of parcels, not a status of every file."""
    source = tmp_path / "in put%20"
    odd_files(source)
    for c in {*string.punctuation, " ", "é", " ", "ع", "😀", "\x85", "\t"} - {"/"}:
        (source / f"n{c}n.txt").write_text("x")
    want = rows(corpus.scan_corpus(spark, str(source)).select("source_name"))
    monkeypatch.setattr(corpus, "LISTED", 3, raising=False)
    names = corpus.scan_corpus(spark, str(source)).select("source_name")
    assert rows(names) == want and len(want) > 40
    assert len(names.inputFiles()) == 1
    # and no file is opened for its name
    assert "ArrowEvalPython" not in names._jdf.queryExecution().executedPlan().toString()


def test_pages_of_a_large_folder(spark, tmp_path, monkeypatch):
    odd_files(tmp_path)
    for i in range(3):
        (tmp_path / f"large{i}.txt").write_text(f"{i}" * (9 << 20))
    (tmp_path / "huge.md").write_text("h" * (20 << 20))
    want = rows(corpus.scan_corpus(spark, str(tmp_path)))
    monkeypatch.setattr(corpus, "LISTED", 3, raising=False)
    found = corpus.scan_corpus(spark, str(tmp_path))
    assert rows(found) == want and found.dtypes == [("source_name", "string"), ("page_number", "int"), ("text", "string")]
    assert len(found.inputFiles()) == 2
    # a condition on the text does not read the files a second time
    short = found.filter("length(text) < 100")
    assert short._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert rows(short) == [r for r in want if len(r[2]) < 100]


def test_large_folders_without_pages(spark, tmp_path, listed):
    (tmp_path / "c.pdf").write_text("x")
    found = corpus.scan_corpus(spark, str(tmp_path))
    assert found.columns == ["source_name", "page_number", "text"] and found.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.scan_corpus(spark, str(tmp_path / "nothing"))
    (tmp_path / "a.txt").write_text("x")
    assert rows(corpus.scan_corpus(spark, str(tmp_path), ["md"])) == []
    # patterns and single files stay with Spark's reader
    assert rows(corpus.scan_corpus(spark, str(tmp_path / "*.txt"))) == rows(corpus.scan_corpus(spark, str(tmp_path / "a.txt"))) == [("a.txt", 0, "x")]


def test_parcels(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"f{i}.txt").write_text("x" * 1000)
    uri = listing.task_uri(spark, str(tmp_path))
    assert listing.holds_more(spark, uri, 99) and not listing.holds_more(spark, uri, 100)
    listing.write_listing(spark, uri, ["txt"], str(tmp_path / "out"), 10 * (1000 + listing.FILE_BYTES))
    per_parcel = spark.read.parquet(str(tmp_path / "out")).groupBy("parcel").count()
    assert rows(per_parcel) == [(i, 10) for i in range(10)]
    # a file over the bound has a parcel of its own
    listing.write_listing(spark, uri, ["txt"], str(tmp_path / "each"), 1)
    assert spark.read.parquet(str(tmp_path / "each")).select("parcel").distinct().count() == 100


def batches(folder):
    return len(list((folder / "checkpoint" / "commits").glob("[0-9]*")))


def test_a_stream_keeps_no_names_in_the_driver(spark, tmp_path):
    """The file source, which lives in the driver, sees parcels."""
    source = tmp_path / "in"
    odd_files(source)
    for i in range(300):
        (source / f"f{i}.txt").write_text(f"text {i}")
    want = rows(corpus.scan_corpus(spark, str(source)))
    out = runner.append(runner.read_corpus(spark, str(source)), "driver", str(tmp_path / "out"))
    assert rows(out) == want
    seen = [line for log in (tmp_path / "out" / "checkpoint" / "sources").rglob("[0-9]*") if log.is_file()
            for line in log.read_text().splitlines()[1:]]
    assert len(seen) == 1


def test_a_stream_takes_a_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    each = 100 + 1024

    def put(names):
        for n in names:
            (source / n).write_text("x" * 100)

    def run(stream):
        return sorted(r.source_name for r in runner.append(stream, "once", str(tmp_path / "out")).collect())

    put(["a.txt", "b.md", "c.pdf"])
    first = runner.read_corpus(spark, str(source), each, str(tmp_path / "listings"))
    assert run(first) == ["a.txt", "b.md"] and batches(tmp_path / "out") == 2
    # a later call with the checkpoint
    put(["d.txt"])
    (source / "a.txt").write_text("changed")
    assert run(runner.read_corpus(spark, str(source))) == ["a.txt", "b.md", "d.txt"]
    # a later listing of the same stream, after a file went
    (source / "b.md").unlink()
    put(["e.md"])
    runner.list_corpus(spark, str(source), str(tmp_path / "listings"))
    assert run(first) == ["a.txt", "b.md", "d.txt", "e.md"]


def test_an_empty_folder_streams_no_pages(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = runner.read_corpus(spark, str(source), listings=str(tmp_path / "listings"))
    assert runner.append(jobs.ingest_stream(stream), "empty", str(tmp_path / "out")).count() == 0
    (source / "a.txt").write_text("one two")
    runner.list_corpus(spark, str(source), str(tmp_path / "listings"))
    assert [r.chunk_id for r in runner.append(jobs.ingest_stream(stream), "empty", str(tmp_path / "out")).collect()] == ["a_0_0"]
