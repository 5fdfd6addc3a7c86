import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import bm25, search


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_tokenize(spark):
    text = "The `Service_Mesh` is NOT a gRPC-Web thing, über-cool! x __ok__"
    assert one(spark, T.tokenize(F.col("t")), t=text) == ["service_mesh", "service", "mesh", "grpc-web", "thing", "ber-cool", "ok"]
    assert one(spark, T.tokenize(F.col("t"), split_bonded=True), t="service_mesh") == ["service", "mesh"]
    assert one(spark, T.tokenize(F.col("t")), t=None) == []
    assert one(spark, T.tokenize(F.col("t")), t="") == []


def test_phrases(spark):
    assert one(spark, T.clean_phrase(F.col("t")), t="  `Event`  Bus (v2)! ") == "event bus v2"
    assert one(spark, T.bonded_token(F.col("t")), t="Event-Bus v2") == "event_bus_v2"
    assert one(spark, T.display_name(F.col("t")), t="event-bus API") == "Event Bus API"
    assert one(spark, T.pad4(F.col("t")), t="12345") == "12345" and one(spark, T.pad4(F.col("t")), t="7") == "0007"
    assert one(spark, T.round_half_up(F.lit(-0.0005), 3), t="") == 0.0


def test_entities_and_citations(spark):
    text = "Use `mTLS` and GKE with google  cloud, see ADR-7 and docs/adr/0012-x.md, legacy ADR 3; THE end"
    assert one(spark, T.entities(F.col("t")), t=text) == ["mtls", "gke", "adr-7", "google-cloud", "adr-0007", "adr-0003"]
    assert one(spark, T.citations(F.col("t"), F.lit("0012")), t=text) == ["3"]


def brute(docs, query, k1=1.2, b=0.75):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for d, toks in docs.items():
        s = 0.0
        for t in dict.fromkeys(query):
            df, tf = sum(t in x for x in docs.values()), toks.count(t)
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(toks) / avg)) if tf else 0
        if s:
            out[d] = s
    return out


def test_bm25_against_brute_force(spark):
    docs = {"a": "redis cache redis".split(), "b": "kafka broker cache".split(), "c": "zebra kafka".split(), "d": []}
    chunks = spark.createDataFrame([(k, k, " ".join(v)) for k, v in docs.items()] + [("n", "n", None)], "chunk_id string, doc_id string, text string")
    index = bm25.build(chunks)
    queries = spark.createDataFrame([("q1", "zebra cache zebra"), ("q2", ""), ("q3", None), ("q4", "unknown")], "query_id string, text string")
    terms = bm25.query_terms(queries)
    got = bm25.score(index, terms)
    rows = {(r.query_id, r.chunk_id): r.score for r in got.collect()}
    want = brute(docs, "zebra cache".split())
    assert {k[1] for k in rows} == set(want) and all(abs(rows[("q1", d)] - s) < 1e-9 for d, s in want.items())
    assert {r.chunk_id: r.matched_terms for r in bm25.matched_terms(index, terms, got).collect()} == {"a": ["cache"], "b": ["cache"], "c": ["zebra"]}
    assert {(r.doc_id, r.term) for r in bm25.attribution(index, terms).collect()} == {("a", "cache"), ("b", "cache"), ("c", "zebra")}


def test_cosine(spark):
    schema = "a array<double>, b array<double>"
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0]), ([0.0, 0.0], [1.0, 2.0])]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(search.cosine(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 9) for x in got] == [1.0, 0.0, -1.0, 0.0]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], schema).select(search.cosine(F.col("a"), F.col("b"))).collect()


def test_dense_and_hybrid(spark):
    corpus = spark.createDataFrame([("a#1", [1.0, 0.0]), ("a#2", [0.9, 0.1]), ("b#1", [0.0, 1.0]), ("z#1", [0.0, 0.0]), ("n#1", None), ("w#1", [1.0]), ("i#1", [float("nan"), 1.0])], "chunk_id string, embedding array<float>")
    docs = spark.createDataFrame([("a#1", "a", "accepted"), ("a#2", "a", "accepted"), ("b#1", "b", "Proposed"), ("z#1", "z", "accepted")], "chunk_id string, doc_id string, status string")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    scores = search.dense_scores(queries, corpus)
    assert {r.chunk_id: round(r.similarity, 3) for r in scores.collect()} == {"a#1": 1.0, "a#2": 0.994, "b#1": 0.0, "z#1": 0.0}
    assert [(r.doc_id, r.chunk_id) for r in search.dense_search(scores, docs, 5, 0.0, ["accepted"]).orderBy("similarity", ascending=False).collect()] == [("a", "a#1"), ("z", "z#1")]
    sparse = spark.createDataFrame([("q", "b#1", "b", None, 4.0)], "query_id string, chunk_id string, doc_id string, section_type string, score double")
    got = {r.doc_id: (round(r.fused, 6), round(r.blended, 3)) for r in search.hybrid_search(scores, sparse, docs, 5, 0.1).collect()}
    assert got == {"a": (round(1 / 61, 6), 1.0), "b": (round(1 / 63 + 1 / 61, 6), 1.0)}
    with pytest.raises(ValueError):
        search.dense_search(scores, docs, 0)


def test_ranks_by_cells_equal_one_window(spark):
    rows = [("q", f"c{i:03d}", float(i * 37 % 50) / 25 - 1) for i in range(300)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, s double")
    got = {r.chunk_id: r.n for r in search.row_number_by_cells(df, "query_id", "s", "chunk_id", -1.0, 1.0, "n").collect()}
    want = {c: n + 1 for n, (_, c, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}
    assert got == want


def test_text_queries_ask_with_the_whole_row(spark, tmp_path):
    from lodestone.plans import search_queries

    rows = [(20, "\n\nqueue of billing events", "en"), (1, "other first line\nbilling", "en"), (40, "title\nkafka broker", "en"), (2, "kafka", "en"), (3, "nothing alike", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.query_id, r.doc_id): r.terms for r in search_queries.QUERIES["bm25_search"](spark, str(tmp_path)).collect()}
    assert found[20, 1] == "billing" and found[40, 2] == "kafka" and set(found) == {(20, 20), (20, 1), (40, 40), (40, 2)}


def test_best_attribution_meets_each_term_only_with_its_first_documents(spark):
    docs = [(d, f"cache {'redis ' * (d % 7 + 1)}" + ("kafka" if d % 3 else "zebra_crossing a--b")) for d in range(60)]
    index = bm25.stored(bm25.build(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "doc_id"))
    terms = bm25.query_terms(spark.createDataFrame([(q, t) for q, t in docs if q % 20 == 0] + [(-1, ""), (-2, None)], "query_id bigint, text string"))
    every = bm25.attribution(index, terms).withColumn("weight", F.round("weight", 6))
    want = search.top_k(every, "query_id", [F.desc("weight"), F.asc("doc_id"), F.asc("term")], 6).select("query_id", "doc_id", "term", "tf", "weight")
    got = bm25.best_attribution(index, terms, 6)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and got.count() == 18
    split = bm25.Index(index.postings, index.frequencies, index.totals, index.packed, whole=False)
    assert sorted(bm25.best_attribution(split, terms, 6).select(want.columns).collect()) == sorted(want.collect())


def test_index_counts_texts_of_one_key_together_and_packs_tokens_in_order(spark):
    rows = [(1, "b_side a--b -b_side- Über"), (2, "cache redis cache"), (2, "redis cache redis")]
    index = bm25.stored(bm25.build(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "doc_id"))
    got = {(r.chunk_id, r.term): (r.tf, r.length) for r in index.postings.collect()}
    assert got == {(1, "b_side"): (2, 6), (1, "side"): (2, 6), (1, "a--b"): (1, 6), (1, "ber"): (1, 6), (2, "cache"): (3, 3), (2, "redis"): (3, 3)}
    terms = bm25.query_terms(spark.createDataFrame([(7, rows[0][1])], "query_id bigint, text string"))
    assert [r.term for r in terms.orderBy("ord").collect()] == ["b_side", "side", "a--b", "ber"]


def test_best_gives_the_first_rows_of_all_scores_ties_by_key(spark):
    from lodestone.operators.best import best

    words = "redis cache kafka broker queue zebra ledger".split()
    docs = [(d, " ".join(w for i, w in enumerate(words) if (d % 97 >> i) & 1) + f" cache word{d % 50}" * (d % 3), "en" if d % 4 else "xx") for d in range(1300)] + [(2000, "", "en")]
    chunks = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    index = bm25.stored(bm25.build(chunks, "doc_id", "doc_id", "lang"))
    terms = bm25.query_terms(spark.createDataFrame([(q, t) for q, t, _ in docs if q % 100 == 7] + [(-1, ""), (-2, "unknown")], "query_id bigint, text string"))
    every = bm25.score(index, terms).withColumn("score", F.round("score", 6))
    ordered = [F.desc("score"), F.asc("chunk_id")]
    want = search.top_k(every, "query_id", ordered, 4).select("query_id", "chunk_id", "score")
    assert sorted(search.top_k(best(index, terms, 4), "query_id", ordered, 4).select(want.columns).collect()) == sorted(want.collect())
    ranked = every.withColumn("r", F.row_number().over(search.W.partitionBy("query_id").orderBy(*ordered)))
    some = best(index, terms, 4, counts=F.col("section_type") == "xx").withColumn("r", F.row_number().over(search.W.partitionBy("query_id").orderBy(*ordered)))
    first = lambda df: sorted(search.top_k(df.where("section_type = 'xx'"), "query_id", ordered, 4).select("query_id", "chunk_id", "score", "r").collect())
    assert first(some) == first(ranked)


def test_hybrid_search_by_counts_equals_ranking_all_pairs(spark):
    from lodestone.operators import best

    words = "redis cache kafka broker queue zebra ledger".split()
    docs = [(d, " ".join(w for i, w in enumerate(words) if (d % 61 >> i) & 1) + f" word{d % 17}", "en" if d % 5 else "xx") for d in range(200)]
    chunks = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    index = bm25.stored(bm25.build(chunks, "doc_id", "doc_id", "lang"))
    terms = bm25.query_terms(chunks.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "text"))
    vectors = spark.createDataFrame([(d, [float(d % 7) - 3, float(d % 11) - 4, 1.0]) for d in range(90)], "chunk_id bigint, embedding array<double>")
    dense = search.dense_scores(vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), vectors).withColumn("similarity", F.round("similarity", 6))
    every = bm25.score(index, terms).withColumn("score", F.round("score", 6))
    want = search.hybrid_search(dense, every, chunks.selectExpr("doc_id AS chunk_id", "doc_id", "lang AS status"), 5, 0.2, statuses=["en"])
    plain = lambda df: sorted((r.query_id, r.doc_id, round(r.fused, 9), round(r.blended, 9)) for r in df.collect())
    assert plain(best.hybrid_search(dense, index, terms, ["en"], 5, 0.2)) == plain(want)
