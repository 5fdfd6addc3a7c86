import io
import json
import subprocess
import urllib.error

import pytest

from lodestone.api import Corpus
from lodestone.operators.store import Store
from lodestone.sources import files, remote
from lodestone.streaming import ingest


def test_corpus_round(spark, tmp_path):
    d = tmp_path / "adr"
    (d / "legacy").mkdir(parents=True)
    (d / "0001-a.md").write_text("# ADR-0001: Redis\n\n* Status: accepted\n\n## Context\n\nSessions in redis\n")
    (d / "0002-b.md").write_text("# ADR-0002: Kafka\n\n* Status: proposed\n\n## Context\n\nEvents\n")
    (d / "README.md").write_text("# x")
    (d / "template-x.md").write_text("# x")
    (d / "legacy" / "0009-c.md").write_text("# ADR-0009: Old")
    corpus = Corpus(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        corpus.list()
    first = corpus.index_directory(str(d))
    assert (first["total"], first["indexed"], first["removed"]) == (2, 2, 0)
    (d / "0002-b.md").unlink()
    second = corpus.index_directory(str(d))
    assert (second["indexed"], second["skipped"], second["removed"]) == (0, 1, 1)
    assert [r.id for r in corpus.list().collect()] == ["0001"]
    got = corpus.search(spark.createDataFrame([("q", "redis sessions")], "query_id string, text string"), threshold=0.1).collect()
    assert [r.doc_id for r in got] == ["0001"]
    with pytest.raises(FileNotFoundError):
        corpus.index_directory(str(tmp_path / "none"))


def test_snapshot(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"version": "1", "createdAt": "t", "documents": {"1": {"id": "1", "metadata": {"id": "1", "title": "T", "status": "accepted"}, "sections": {"context": "c", "decision": "d"}}}, "chunks": [{"chunkId": "1#summary", "docId": "1", "sectionType": "summary", "text": "t", "embedding": [0.5]}]}))
    docs, chunks = files.read_json_snapshot(spark, str(path))
    assert docs.first().metadata.title == "T" and chunks.first().embedding == [0.5]
    corpus = Corpus(spark, str(tmp_path / "store"))
    assert corpus.load_snapshot(str(path), str(tmp_path / "cache")) is False and corpus.documents.first().metadata.status == "accepted"


class Answer(io.BytesIO):
    headers = {"ETag": "e1"}


def test_conditional_fetch(tmp_path):
    seen = []

    def opener(request):
        seen.append(dict(request.headers))
        if len(seen) == 1:
            return Answer(b"{}")
        raise urllib.error.HTTPError(request.full_url, 304, "same", {}, None)

    path, cached = remote.fetch_snapshot("http://h/x", str(tmp_path), "tok", opener=opener)
    assert not cached and seen[0]["Authorization"] == "Bearer tok"
    again, cached = remote.fetch_snapshot("http://h/x", str(tmp_path), opener=opener)
    assert cached and again == path and seen[1]["If-none-match"] == "e1"
    with pytest.raises(urllib.error.HTTPError):
        remote.fetch_snapshot("http://h/other", str(tmp_path), opener=opener)


def test_git_and_config(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "f.txt").write_text("a\n")
    run("add", ".")
    assert "+a" in remote.git_diff(str(tmp_path))
    run("commit", "-qm", "x")
    (tmp_path / "f.txt").write_text("b\n")
    assert "+b" in remote.git_diff(str(tmp_path)) and remote.git_diff(str(tmp_path), staged=True) == ""
    with pytest.raises(ValueError):
        remote.git_diff(str(tmp_path), "--output=x")
    (tmp_path / ".lodestone.json").write_text('{"topK": 3}')
    (tmp_path / "sub").mkdir()
    assert files.load_config(str(tmp_path / "sub"), {"ADR_DIRS": "a,b"}) == {"topK": 3, "directories": "a,b"}
    assert files.discover_directories(None, str(tmp_path), {"ADR_DIRS": "a, b"}) == ["a", "b"]


def test_urls(spark):
    df = spark.createDataFrame([("7", "docs/adr/0007 x.md"), ("12", None)], "id string, relative_path string")
    hub = remote.record_urls(df, "github", {"owner": "o", "repository": "r"}).collect()
    assert hub[0].web_url == "https://github.com/o/r/blob/main/docs/adr/0007 x.md" and hub[1].raw_url.endswith("/main/docs/adr/0012.md")
    azure = remote.record_urls(df, "azure-devops", {"organization": "o", "project": "p q", "repository": "r"}).collect()
    assert "path=%2Fdocs%2Fadr%2F0007%20x.md" in azure[0].web_url and "/p%20q/" in azure[0].web_url
    own = remote.record_urls(df, "gitlab", {"web_template": "x/{branch}/{id}"}).collect()
    assert own[0].web_url == "x/main/7" and own[0].raw_url is None


def test_streaming_merge(spark, tmp_path):
    store, schema = Store(spark, str(tmp_path / "store")), "repo string, id string, revision int, title string"
    for rows in ([("r", "1", 1, "a"), ("r", "1", 2, "b"), ("r", "2", 1, "c")], [("r", "1", 1, "late"), ("r", "2", 2, "d"), ("r", "3", 1, "e")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), schema, store, str(tmp_path / "cp"), ["repo", "id"], ["revision"]).awaitTermination()
    assert sorted((r.id, r.title) for r in store.read("documents").collect()) == [("1", "b"), ("2", "d"), ("3", "e")]
    store.delete("documents", spark.createDataFrame([("r", "2")], "repo string, id string"), ["repo", "id"])
    assert store.read("documents").count() == 2


def test_a_store_outlives_a_crash_before_the_switch(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    one, two = (spark.createDataFrame([(i,)], "id int") for i in (1, 2))
    store.write(documents=one)

    class Dies:
        def __getattr__(self, name):
            if name == "rename":
                raise KeyboardInterrupt
            return getattr(fs, name)

    fs = store._fs
    monkeypatch.setattr(store, "_fs", Dies())
    with pytest.raises(KeyboardInterrupt):
        store.write(documents=two)
    monkeypatch.setattr(store, "_fs", fs)
    assert [r.id for r in store.read("documents").collect()] == [1]
    store.write(documents=two)
    assert store.vacuum() >= 3 and [r.id for r in store.read("documents").collect()] == [2]
    assert len([n for n in (tmp_path / "store").iterdir() if not n.name.startswith(".")]) == 2
