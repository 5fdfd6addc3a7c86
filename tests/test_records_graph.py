from lodestone.operators import changeset, graph, overlap, records, vocabulary
from lodestone.session import materialize

TEXT = """# ADR-0007: Keep sessions in a cache

* Status: Superseded by [adr-0009](0009.md)
- **Date**: decided 2024-03-01 or so
* Deciders: Ana, Ben; Cy
* Depends on: ADR-0002, 0002 and 003
* Status: accepted

## Context and Problem Statement

Sessions vanish. See ADR-0012.

## Decision

First.

## Decision

Second with `redis`.

```mermaid
graph TD
```
"""


def parse(spark, text, name="docs/adr/0007-keep.md"):
    return records.parse(spark.createDataFrame([(name, text)], "path string, content string"), "path", "content").first()


def test_record(spark):
    r = parse(spark, TEXT)
    assert (r.parsed_id, r.metadata.title, r.metadata.status, r.metadata.date) == ("0007", "Keep sessions in a cache", "accepted", "2024-03-01")
    assert r.metadata.deciders == ["Ana", "Ben", "Cy"] and r.metadata.depends_on == ["0002", "003"]
    assert r.sections.context == "Sessions vanish. See ADR-0012." and r.sections.decision.startswith("Second with") and r.sections.diagrams == ["graph TD"]
    assert r.inline_references == ["0002", "0012", "0009"] or set(r.inline_references) == {"0009", "0002", "0012"}
    assert r.summary_text.startswith("ADR 0007: Keep sessions in a cache\nStatus: accepted\nContext: Sessions vanish.")


def test_odd_records(spark):
    assert parse(spark, TEXT.replace("\n", "\r\n")).sections.context == "Sessions vanish. See ADR-0012."
    empty = parse(spark, None, "x/my_note.md")
    assert (empty.parsed_id, empty.metadata.title, empty.metadata.status, empty.sections.context) == ("my_note", "my note", "proposed", "")
    assert parse(spark, "# 12.: -Named\n", "x/n.md").parsed_id in ("12", "n")


def test_chunks(spark):
    df = records.parse(spark.createDataFrame([("0007-a.md", TEXT)], "path string, content string"), "path", "content")
    got = {r.section_type: r.text for r in records.chunks(df).collect()}
    assert set(got) == {"summary", "context", "decision"} and got["context"] == "ADR 0007 Context: Sessions vanish. See ADR-0012."


EDGE = "repo string, source string, target string, type string, explicit boolean"
NODE = "repo string, id string, title string, status string, date string, category string, doc_ord int"


def test_traversals(spark):
    edge = spark.createDataFrame([("r", "3", "2", "DEPENDS_ON", True), ("r", "2", "1", "EXTENDS", True), ("r", "4", "3", "AMENDS", True), ("r", "5", "1", "REFERENCES", False), ("r", "9", "8", "OBSOLETES", True), ("r", "8", "7", "OBSOLETES", True)], EDGE)
    node = spark.createDataFrame([("r", str(i), f"t{i}", "deprecated" if i == 1 else "accepted", None, None, i) for i in range(1, 10)], NODE)
    start = lambda i: spark.createDataFrame([("r", i)], "repo string, id string")
    assert {(r.id, r.depth, r.outdated) for r in graph.dependencies(start("3"), edge, node).collect()} == {("2", 1, False), ("1", 2, True)}
    r = graph.impact(start("1"), edge).first()
    assert (r.direct, r.extensions, r.citations, r.transitive, r.score) == (0, 1, 1, 2, 5.0)
    assert {r.id for r in graph.ancestors(start("9"), edge).collect()} == {"8", "7"}
    assert [(r.active, r.steps) for r in graph.lineage(start("7"), edge).collect()] == [("9", 2)]
    assert {r.id for r in graph.neighborhood(start("2"), edge, 1).collect()} == {"1", "3"}
    assert graph.cycles(edge).count() == 0


def test_cycles_and_issues(spark):
    edge = spark.createDataFrame([("r", "1", "2", "DEPENDS_ON", True), ("r", "2", "3", "DEPENDS_ON", True), ("r", "3", "1", "DEPENDS_ON", True), ("r", "4", "1", "DEPENDS_ON", True), ("r", "5", "99", "EXTENDS", True), ("r", "6", "5", "OBSOLETES", True)], EDGE)
    node = spark.createDataFrame([("r", str(i), "t", "superseded" if i == 1 else "accepted", None, None, i) for i in range(1, 8)], NODE)
    assert {(r.id, r.component) for r in graph.cycles(edge).collect()} == {("1", "1"), ("2", "1"), ("3", "1")}
    got = {(r.code, r.id, r.other) for r in graph.issues(edge, node).collect()}
    assert got == {("DANGLING_TARGET", "5", "99"), ("STATUS_CONTRADICTION", "3", "1"), ("STATUS_CONTRADICTION", "4", "1"), ("SPLIT_BRAIN", "5", "6"), ("ORPHAN_RECORD", "7", None)}
    start = spark.createDataFrame([("r", "1")], "repo string, id string")
    assert {r.id for r in graph.traverse(start, edge).collect()} == {"2", "3"}


def test_vocabulary(spark):
    schema = "repo string, id string, doc_ord int, raw_content string, metadata struct<title: string>, sections struct<context: string, decision: string, considered_options: string>"
    rows = [("r", "1", 1, "# ADR-1: Event Bus\n`rate limiter` for APIs", ("Event Bus",), ("The event bus fails. event bus again", "", None)), ("r", "2", 2, "text", ("t",), ("An event bus", "", None))]
    got = {r.term: r for r in vocabulary.harvest(spark.createDataFrame(rows, schema)).collect()}
    assert got["event_bus"].doc_count == 2 and "header" in got["event_bus"].sources and got["rate_limiter"].sources == ["code_span"]
    texts = spark.createDataFrame([(1, "The Event  bus-like event bus"), (2, None), (3, "")], "n int, text string")
    bonded = {r.n: r.text for r in vocabulary.bond(texts, vocabulary.harvest(spark.createDataFrame(rows, schema))).collect()}
    assert bonded == {1: "The Event  bus-like event_bus", 2: None, 3: ""}


DIFF = """diff --git a/package.json b/package.json
--- a/package.json
+++ b/package.json
+    "kafkajs": "^2.0.0",
+    "@types/node": "1",
-    "old": "1"
diff --git a/src/bus/consumer.ts b/src/bus/consumer.ts
new file mode 100644
+++ b/src/bus/consumer.ts
+import { Kafka } from 'kafkajs'
"""


def test_changeset(spark):
    diffs = spark.createDataFrame([("d", DIFF), ("e", ""), ("n", None)], "diff_id string, diff string")
    files = changeset.files(diffs)
    assert [(r.path, r.change_type, len(r.added), len(r.deleted)) for r in files.orderBy("file_ord").collect()] == [("package.json", "modified", 2, 1), ("src/bus/consumer.ts", "added", 1, 0)]
    deps = changeset.dependencies(files)
    assert [(r.name, r.version) for r in deps.collect()] == [("kafkajs", "^2.0.0")]
    keys = {r.keyword for r in changeset.keywords(files).collect()}
    assert {"package", "bus", "consumer", "kafka", "kafkajs"} <= keys and "src" not in keys
    hits = spark.createDataFrame([("d", "1", 0.9, ["bus"]), ("d", "1", 0.5, ["kafka"]), ("d", "2", 0.4, [])], "diff_id string, doc_id string, score double, terms array<string>")
    docs = spark.createDataFrame([("1", "accepted", "The consumer.ts file uses kafkajs"), ("2", "superseded", "x")], "doc_id string, status string, text string")
    got = {r.doc_id: (r.score, r.classification, r.files, sorted(r.terms)) for r in changeset.align(hits, files, deps, docs).collect()}
    assert got == {"1": (0.9, "binding", ["src/bus/consumer.ts"], ["bus", "kafka", "kafkajs"]), "2": (0.4, "historical", [], [])}


def test_verdicts(spark):
    rows = [("a", 0.8, 0.0, 0.0), ("b", 0.3, 0.7, 0.2), ("c", 0.53, 0.1, 0.1), ("d", 0.1, 0.1, 0.1), ("e", 0.0, 0.7, 0.6)]
    df = spark.createDataFrame([("x", n, o, c, d, 0.0, 0) for n, o, c, d in rows], "draft_id string, doc_id string, overall double, context double, decision double, title double, shared int")
    judged = overlap.verdicts(df)
    assert {r.doc_id: r.verdict for r in judged.collect()} == {"a": "DUPLICATE_RISK", "b": "CONFLICT_RISK", "c": "EXTENSION_CANDIDATE", "e": "DUPLICATE_RISK"}
    assert overlap.draft_verdicts(judged).first().verdict == "DUPLICATE_RISK"


def test_overlap_by_titles_and_shared_entities(spark):
    from lodestone.operators import store

    near = spark.createDataFrame([("a", "x", 0.71, 0.0, 0.0), ("a", "y", 0.71, 0.0, 0.0), ("a", "z", 0.0, 0.56, 0.2), ("a", "w", 0.1, 0.1, 0.1)], "draft_id string, doc_id string, overall double, context double, decision double")
    mine = spark.createDataFrame([("a", ["kafka", "jwt"])], "draft_id string, entities array<string>")
    theirs = spark.createDataFrame([("x", ["jwt", "kafka"]), ("y", ["kafka"]), ("z", ["jwt"]), ("w", ["jwt"]), ("v", None)], "doc_id string, entities array<string>")
    titles = overlap.title_similarities(
        spark.createDataFrame([("a", "Queue for billing events")], "draft_id string, text string"), spark.createDataFrame([("v", "Queue for billing events"), ("w", "Unlike name")], "doc_id string, text string"), store.HashingEmbedder
    )
    drafts = spark.createDataFrame([("a", "summary", [1.0, 0.0])], "draft_id string, section_type string, embedding array<float>")
    chunks = spark.createDataFrame([("v#summary", "v", "summary", [0.0, 1.0]), ("w#summary", "w", "summary", [0.6, 0.8])], "chunk_id string, doc_id string, section_type string, embedding array<float>")
    got = {r.doc_id: r.verdict for r in overlap.verdicts(overlap.with_evidence(near, titles, mine, theirs, drafts, chunks)).collect()}
    assert [tuple(round(v, 3) for v in r[2:]) for r in overlap.similarities(drafts, chunks).collect()] == [(0.6, 0.6, 0.6)]
    words = overlap.shared_words(spark.createDataFrame([("a", "Use the cache for billing"), ("b", ""), ("c", "one")], "draft_id string, text string"), spark.createDataFrame([("x", "Cache for the billing"), ("y", "one two three"), ("z", "use the CACHE for billing"), ("n", None)], "doc_id string, text string"))
    assert {(r.draft_id, r.doc_id): round(r.title, 4) for r in words.collect()} == {("a", "x"): 0.8944, ("a", "z"): 1.0}
    assert got == {"x": "DUPLICATE_RISK", "y": "EXTENSION_CANDIDATE", "z": "CONFLICT_RISK", "v": "EXTENSION_CANDIDATE"}


def test_graph_deeper_than_fifty(spark):
    n = 52
    name = lambda i: f"{i:04d}"
    rows = [("r", name(i + 1), name(i), "OBSOLETES") for i in range(n)] + [("r", name(i), name(i + 1), "DEPENDS_ON") for i in range(n)] + [("r", name(n), name(0), "DEPENDS_ON")]
    rows += [("s", name(i % 5 + 1), name(i), "OBSOLETES") for i in range(1, 6)] + [("s", name(1), "0900", "OBSOLETES"), ("s", "0900", "0901", "OBSOLETES"), ("s", "0950", "0950", "OBSOLETES")]
    edge = materialize(spark.createDataFrame(rows, "repo string, source string, target string, type string").repartition(2), "edges")
    start = spark.createDataFrame([("r", name(0)), ("r", name(n)), ("s", "0901"), ("s", "0003"), ("s", "0950"), ("s", "0999")], "repo string, id string")
    got = {(r.repo, r.start): (r.active, r.steps) for r in graph.lineage(start, edge).collect()}
    assert got == {("r", name(0)): (name(n), n), ("r", name(n)): (name(n), 0), ("s", "0901"): ("0005", 6), ("s", "0003"): ("0002", 4), ("s", "0950"): ("0950", 0), ("s", "0999"): ("0999", 0)}
    deep = {(r.start, r.id): r.depth for r in graph.ancestors(start.where("repo = 'r'"), edge).collect()}
    assert deep == {(name(n), name(i)): n - i for i in range(n)}
    ring = edge.where("type = 'DEPENDS_ON'")
    assert {(r.id, r.component) for r in graph.cycles(ring).collect()} == {(name(i), name(0)) for i in range(n + 1)}


def test_bonding_with_the_whole_vocabulary(spark, tmp_path):
    from lodestone.plans import analysis_queries

    texts = spark.createDataFrame([(1, "A Rate Limiter and an event bus."), (2, "rate\nlimiter"), (3, None), (4, "A Rate Limiter and an event bus.")], "n int, text string")
    terms = spark.createDataFrame([("rate limiter", "rate_limiter"), ("event bus", "event_bus"), ("unseen thing", "unseen_thing"), ("word", "word")], "raw_phrase string, term string")
    want = {1: "A rate_limiter and an event_bus.", 2: "rate_limiter", 3: None, 4: "A rate_limiter and an event_bus."}
    assert {r.n: r.text for r in vocabulary.bond(texts, terms).collect()} == want
    assert {r.n: r.text for r in vocabulary.bond(texts, terms, most=1).collect()} == want
    meta = "named_struct('title', 'x') AS metadata, named_struct('context', '', 'decision', '', 'considered_options', '') AS sections"
    spark.sql(f"SELECT 'r' AS repo, '1' AS id, 1 AS revision, 0 AS doc_ord, false AS is_deleted, '## Rate limiter' AS raw_content, {meta}").write.parquet(f"{tmp_path}/documents_parsed.parquet")
    spark.sql("SELECT 'c' AS chunk_id, 'the rate limiter' AS text").write.parquet(f"{tmp_path}/chunks.parquet")
    assert analysis_queries.QUERIES["phrase_bonding"](spark, str(tmp_path)).first().text == "the rate_limiter"
