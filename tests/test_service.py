"""Files, pages, the store, the tools and the stream."""

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quernstone.operators.hybrid import Fusion
from quernstone.plans.api import Service, debug_log
from quernstone.plans.store import IndexStore
from quernstone.sources.embeddings import embed_chunks
from quernstone.sources.files import find_files, read_files
from quernstone.sources.html import site_root, to_markdown
from quernstone.streaming.ingest import ingest

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)
CONTENT = "# Title\n\n" + "\n".join(f"Line {k} about brokers and streams." for k in range(14)) + "\n## Part\n\nTopic partitions hold records.\n"


@pytest.fixture
def docs(tmp_path):
    (tmp_path / "docs/deep").mkdir(parents=True)
    for name in ("a.md", "b [x].md", "_hidden.md", "deep/c.md", "deep/d.txt"):
        (tmp_path / "docs" / name).write_text(CONTENT + name, "utf-8")
    return tmp_path / "docs"


def service(spark, tmp_path, **more):
    return Service(spark, f"{tmp_path}/store", clock=lambda: NOW, **more)


def test_globs(docs):
    names = lambda p: [x.removeprefix(f"{docs}/") for x in find_files(p)]
    assert names(f"{docs}/*.md") == ["_hidden.md", "a.md", "b [x].md"]
    assert names(f"{docs}/**/*.md") == ["_hidden.md", "a.md", "b [x].md", "deep/c.md"]
    assert len(names(f"{docs}/**")) == 5
    for pattern, error in (("", ValueError), (f"{docs}/*.rst", FileNotFoundError), (f"{docs}/**/deep/*.md", FileNotFoundError), (f"{docs}/[", ValueError), (f"{docs}/dee*", FileNotFoundError)):
        with pytest.raises(error):
            find_files(pattern)


def test_read_files(spark, docs):
    rows = {r.path: r for r in read_files(spark, find_files(f"{docs}/*.md")).collect()}
    assert len(rows) == 3
    for path, r in rows.items():
        assert r.content == open(path, encoding="utf-8").read() and len(r.file_hash) == 64 and len(r.doc_id) == 16


def test_load_query_and_change(spark, docs, tmp_path):
    s = service(spark, tmp_path)
    path = str(docs / "a.md")
    assert s.docs_list() == "No documents currently loaded. Use docs_load or site_load first."
    with pytest.raises(LookupError, match="no documents loaded"):
        s.docs_query("brokers")
    assert s.docs_load(path).startswith("Indexed and cached.\n\ndoc_id: ")
    assert s.docs_load(path).startswith("Loaded from cache.") and "indexed_at: 2024-01-01T00:00:00Z" in s.docs_load(path)
    assert f"Source: {path}#L" in s.docs_query("partitions", path=path)
    assert s.docs_query("zebra", path=path) == "No relevant excerpts found in the indexed document."
    (docs / "a.md").write_text("# New\n\nzebra stripes\n")
    assert s.docs_load(path).startswith("Indexed and cached.")
    assert "zebra" in s.docs_query("zebra", path=path)
    assert "zebra" in s.docs_query("zebra") and "zebra" in service(spark, tmp_path, parity=False).docs_query("zebra")
    for call, error in ((lambda: s.docs_load(" "), "path is required"), (lambda: s.docs_query(" "), "prompt is required"), (lambda: s.docs_query("x", doc_id="nope"), "document not loaded"), (lambda: s.docs_load_glob(""), "pattern is required"), (lambda: s.site_loads([]), "urls is required"), (lambda: s.docs_query("x", doc_id=s.store.list().first().doc_id, path="/other"), "path differs")):
        with pytest.raises((ValueError, LookupError), match=error):
            call()
    with pytest.raises(FileNotFoundError):
        s.docs_load(str(docs / "none.md"))


def test_glob_list_and_export(spark, docs, tmp_path):
    import json

    s = service(spark, tmp_path)
    assert s.docs_load_glob(f"{docs}/**/*.md").startswith("Loaded 4 files (0 cached), ")
    assert s.docs_load_glob(f"{docs}/*.md").startswith("Loaded 3 files (3 cached), ")
    listed = s.docs_list()
    assert listed.startswith("Loaded documents: 4\n\n- doc_id: ") and "  chunks: 2\n" in listed
    first = s.store.list().first().doc_id
    out = json.load(open(s.store.export_json(first, str(tmp_path / "out"))))
    assert out["version"] == 4 and out["num_chunks"] == len(out["chunks"]) and out["doc_freq"]
    assert open(s.store.export_markdown(first, str(tmp_path / "out"))).read().startswith("# Title")


def test_broken_files_among_good_ones(spark, docs, tmp_path):
    (docs / "latin.md").write_bytes(b"# T\xe9te\n\nzebra caf\xe9 stripes\n")
    (docs / "gone.md").symlink_to(docs / "nothing")
    s = service(spark, tmp_path)
    assert s.docs_load_glob(f"{docs}/*.md").startswith("Loaded 4 files (0 cached), ")
    assert "caf\ufffd stripes" in s.docs_query("zebra", path=str(docs / "latin.md"))
    rows = read_files(spark, [str(docs / "a.md"), str(docs / "gone.md"), str(docs / "none.md"), str(docs / "_gone.md")]).collect()
    assert [r.path for r in rows] == [str(docs / "a.md")]
    query = ingest(spark, str(docs), IndexStore(spark, f"{tmp_path}/streamed"), f"{tmp_path}/checkpoint", lambda: NOW, "latin.md")
    query.awaitTermination()
    assert IndexStore(spark, f"{tmp_path}/streamed").documents().count() == 1


def test_one_document_reads_one_bucket(spark, docs, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/store", buckets=16)
    store.index(read_files(spark, find_files(f"{docs}/**/*.md")), NOW)
    first = store.list().first().doc_id
    for rows in (store.chunks(first), store.postings(first), store.markdown(first), store.get(first)):
        assert len({x.split("bucket=")[1].split("/")[0] for x in rows.inputFiles()}) <= 4
        assert "PartitionFilters: [isnotnull(bucket" in rows._jdf.queryExecution().executedPlan().toString() and {r.doc_id for r in rows.collect()} == {first}
    posted = store.postings()
    assert posted.count() == posted.select("doc_id", "chunk_id", "term").distinct().count() > 0
    assert not os.listdir(f"{tmp_path}/store/_next")


def test_version_and_upsert(spark, docs, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/store", buckets=2)
    files = read_files(spark, find_files(f"{docs}/**/*.md"))
    store.index(files, NOW)
    assert store.stale(files).count() == 0
    store.index(files.limit(1), NOW)
    assert store.documents().count() == 4 and store.chunks().select("chunk_id").distinct().count() == store.chunks().count()
    old = store.documents().withColumn("version", F.lit(3)).withColumn("bucket", F.lit(0))
    old.write.mode("overwrite").partitionBy("bucket").parquet(f"{tmp_path}/older/documents")
    assert IndexStore(spark, f"{tmp_path}/older").documents().count() == 0


def test_embeddings(spark, docs, tmp_path):
    def embed(texts):
        return [[1.0, float("partitions" in t.lower())] for t in texts]

    s = service(spark, tmp_path, embed=embed, fusion=Fusion("weighted"))
    s.docs_load(str(docs / "a.md"))
    assert s.store.chunks().where("embedding is null").count() == 0
    assert "###" in s.docs_query("the of", path=str(docs / "a.md"))

    def broken(texts):
        raise OSError("no model")

    failed = embed_chunks(s.store.chunks(), broken)
    assert failed.where("embedding is not null").count() == 0 and failed.count() == s.store.chunks().count()
    assert "###" in service(spark, tmp_path, embed=broken).docs_query("brokers", path=str(docs / "a.md"))


def test_sites(spark, tmp_path):
    def fetch(url):
        if "bad" in url:
            raise RuntimeError("HTTP 404: 404 Not Found")
        return f"<html><body><h1>Page</h1><p>Text of <a href='/x'>link</a> {url}</p></body></html>"

    s = service(spark, tmp_path, fetch=fetch)
    urls = ["https://h.example/a", " ", "https://h.example/bad"]
    assert s.site_loads(urls) == "Loaded 1 sites (0 from cache, 1 failed)\n\n- https://h.example/a (chunks: 1)\n- FAILED: https://h.example/bad (HTTP 404: 404 Not Found)\n"
    assert s.site_loads(urls[:1]).startswith("Loaded 1 sites (1 from cache, 0 failed)")
    assert s.site_loads(urls[:1], force=True).startswith("Loaded 1 sites (0 from cache")
    assert "[link](https://h.example/x)" in s.docs_query("link") and "url: https://h.example/a" in s.docs_list()
    assert "not configured" in service(spark, tmp_path, fetch=None).site_loads(urls[:1])


def test_markdown():
    html = "<head><title>t</title></head><h2>A &amp; B</h2><p>One <b>two</b> <i>x</i><br>y</p><ul><li>a</li><li>b<ol><li>c</li></ol></li></ul><pre>k  v\n</pre><script>z</script><table><tr><th>H</th></tr><tr><td>1</td></tr></table>"
    text = to_markdown(html)
    assert text.startswith("## A & B\n\nOne **two** *x*") and "- a\n- b" in text and "1. c" in text and "```\nk  v\n\n```" in text and "| H |" in text and "z" not in text.replace("zebra", "")
    assert to_markdown(None) == "" and site_root("https://u:p@h.example:8/x") == "https://h.example:8" and site_root("x") == ""


def test_stream(spark, docs, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/store")
    run = lambda check: ingest(spark, str(docs), store, f"{tmp_path}/{check}", lambda: NOW).awaitTermination()
    run("check")
    first = sorted(map(tuple, store.documents().collect()))
    assert len(first) == 3
    run("again")
    assert sorted(map(tuple, store.documents().collect())) == first
    (docs / "e.md").write_text("# E\n\nmore\n")
    run("check")
    assert store.documents().count() == 4


def test_log(tmp_path):
    debug_log(str(tmp_path), NOW).debug("seen")
    assert "seen" in (tmp_path / "debug-2024-01-01.txt").read_text()
