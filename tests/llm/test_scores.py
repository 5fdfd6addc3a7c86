import math
import random
from datetime import datetime

import numpy as np
import pytest

from lodestone.llm import distinctiveness as dis
from lodestone.llm import ideal_point as ideal
from lodestone.llm import mixing

ENTRY = "chunk_id string, term_counts map<string,int>, tokenizer_version string, token_length int, indexed_at timestamp, term string, df int"
CHUNK = "chunk_id string, text string"
T = datetime


def brute_degrees(tokens, window=dis.WINDOW):
    near = {}
    for i, a in enumerate(tokens):
        for b in tokens[i + 1 : i + window]:
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
    return {t: len(near.get(t, ())) or 1 for t in tokens}


def test_graph_of_words(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    texts = {f"c{k}": [r.choice(words) for _ in range(r.randint(1, 30))] for k in range(20)}
    entries = [(c, {t: ts.count(t) for t in ts}, "v2", len(ts), T(2024, 1, 2), None, None) for c, ts in texts.items()]
    stale = [("c0", {"stale": 9}, "v1", 1, T(2024, 1, 1), None, None), ("n", None, "v2", 0, T(2024, 1, 1), None, None), ("e", {}, "v2", 0, T(2024, 1, 1), None, None), (None, {"x": 1}, "v2", 1, T(2024, 1, 1), None, None)]
    upper = [("u", {"Ab": 2, "ab": 3, "Cd": 1}, "v1", 6, T(2024, 1, 1), None, None)]
    chunks = spark.createDataFrame([(c, " ".join(ts).upper() + " other") for c, ts in texts.items()] * 2, CHUNK)
    got = {(x.chunk_id, x.term): x for x in dis.score_terms(spark.createDataFrame(entries + stale + upper, ENTRY), chunks).collect()}
    assert {k for k in got if k[0] == "u"} == {("u", "ab"), ("u", "cd")} and got[("u", "ab")].tf == 5
    assert not any(c in ("n", "e", None) or t == "stale" for c, t in got)
    for c, ts in texts.items():
        for t, d in brute_degrees(ts).items():
            row = got[(c, t)]
            assert row.degree == d and row.df == sum(t in x for x in texts.values()) and row.score > 0
    assert dis.score_terms(spark.createDataFrame([], ENTRY), chunks).count() == 0


def test_rare_terms_score_higher(spark):
    entries = [(f"c{k}", {"common": 1, "rare" if k == 0 else f"x{k}": 1, "word": 1}, "v2", 3, T(2024, 1, 1), None, None) for k in range(10)]
    chunks = spark.createDataFrame([(f"c{k}", f"common {'rare' if k == 0 else f'x{k}'} word") for k in range(10)], CHUNK)
    got = {r.term: r.score for r in dis.score_terms(spark.createDataFrame(entries, ENTRY), chunks).where("chunk_id = 'c0'").collect()}
    assert got["rare"] > got["common"]


def test_vocabulary_spread(spark):
    rows = [(1, "Bus", 5, T(2024, 1, 2)), (1, "bus ", 9, T(2024, 1, 1)), (2, "bus", None, T(2024, 1, 1)), (2, "", 1, T(2024, 1, 1)), (3, None, 1, T(2024, 1, 1))]
    got = dis.vocabulary_spread(spark.createDataFrame(rows, "shard_id bigint, term string, doc_count bigint, harvested_at timestamp")).collect()
    assert [(r.term, r.n_shards, r.doc_count, r.rarity) for r in got] == [("bus", 1, 5, round(math.log(4), 6))]


EVAL = "query_id bigint, chunk_id string, dense_score double, sparse_score double, blended_score double, closeness double, rank int"


def brute_winner(rows):
    low = lambda v: -math.inf if v is None else v
    best = [c for c, a in rows.items() if all(sum(low(x) > low(y) for x, y in zip(a, b)) >= 2 for d, b in rows.items() if d != c)]
    return best[0] if best else None


def test_undisputed_against_brute_force(spark):
    r = random.Random(5)
    data, want = [], {}
    for q in range(40):
        rows = {f"c{k}": tuple(None if r.random() < 0.1 else r.choice([0.1, 0.5, 2.0, 1e9, r.random()]) for _ in range(3)) for k in range(r.randint(1, 9))}
        if q % 2:
            rows["w"] = (5e9, 5e9, r.random())
        data += [(q, c, *s, None, None) for c, s in rows.items()] * 2
        if w := brute_winner(rows):
            want[q] = w
    df = spark.createDataFrame(data + [(None, "x", 1.0, 1.0, 1.0, None, None), (1, None, 1.0, 1.0, 1.0, None, None)], EVAL)
    ranked = ideal.ideal_point_ranking(df)
    assert {x.query_id: x.chunk_id for x in ideal.undisputed(ranked).collect()} == want
    assert ideal.undisputed(ideal.ideal_point_ranking(df.limit(0))).count() == 0


def test_ranking_ignores_range(spark):
    """A score's unit doesn't matter, ties share a rank, and ranks count strictly closer candidates."""
    r = random.Random(3)
    rows = [(f"c{k}", r.random(), r.random(), r.random()) for k in range(50)] + [("t1", 0.5, 0.5, 0.5), ("t2", 0.5, 0.5, 0.5), ("n", None, 0.9, math.inf), ("m", None, None, None)]
    plain = [(1, *x, None, None) for x in rows]
    scaled = [(2, c, None if a is None else a * 1e6, b, d, None, None) for c, a, b, d in rows]
    got = ideal.ideal_point_ranking(spark.createDataFrame(plain + scaled, EVAL)).collect()
    by = {q: {x.chunk_id: (x.rank, x.closeness) for x in got if x.query_id == q} for q in (1, 2)}
    assert all(by[1][c][0] == by[2][c][0] for c in by[1]) and by[1]["t1"] == by[1]["t2"]
    for rank, c in by[1].values():
        assert rank == 1 + sum(o > c for _, o in by[1].values())


def test_pivot_keeps_mass():
    rng = np.random.default_rng(1)
    w, p = rng.integers(1, 500, 400).astype(float), rng.random(400)
    out = mixing.pivot(w, p, 3)
    assert abs((w * out).sum() - (w * p).sum()) < 1e-6 and ((out > 0) & (out < 1)).sum() <= 1
    mean = np.mean([mixing.pivot(w[:6], p[:6], s) for s in range(4000)], axis=0)
    assert np.abs(mean - p[:6]).max() < 0.05


def test_mixture(spark):
    docs = [(i, f"text number {i} " + "word " * (i % 50 + 5), ("Adr-Repo", "wiki_export ", "notes")[i % 3] if i < 600 else "notes", None) for i in range(900)]
    docs += [(1000, "", "notes", None), (1001, None, "notes", None), (1002, "x y z", None, None), (1003, docs[3][1], "notes", None), (1004, " \n", "adr_repo", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, copies int")
    targets = spark.createDataFrame([("adr_repo", 0.5, 2), ("wiki_export", 0.3, None), ("notes", 0.2, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(df, targets)
    rows = mix.collect()
    caps = {"adr_repo": 2, "wiki_export": 1, "notes": 3}
    assert all(1 <= r.copies <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows) and not {1000, 1001, 1002, 1003, 1004} & {r.doc_id for r in rows}
    share = {r.source: r.actual_share for r in mixing.mixture_report(mix, targets).collect()}
    assert all(abs(share[s] - t) < 0.01 for s, t in (("adr_repo", 0.5), ("wiki_export", 0.3), ("notes", 0.2)))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(df, targets).collect()))
    assert mixing.mix_sources(df.limit(0), targets).count() == 0


def test_tree_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    df = spark.createDataFrame([("s", i, 10, 0.3) for i in range(500)], "source string, doc_id bigint, n_tokens bigint, p double")
    out = mixing.round_copies(df, 500).collect()
    assert len(out) == 500 and abs(sum(r.extra for r in out) - 150) <= 1


@pytest.mark.parametrize("name", ["ADR-Repo", " adr repo", "adr_repo"])
def test_source_names(spark, name):
    assert spark.createDataFrame([(name,)], "source string").select(mixing.normal_source()).first()[0] == "adr_repo"
