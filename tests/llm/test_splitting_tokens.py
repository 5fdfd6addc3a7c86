import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import splitting, tokens

ALPHABET = "ab 'srel\n\t  12.,é中👍-_l\u00a0"


@pytest.fixture(scope="module")
def encoder():
    return tokens.ChunkEncoder(tokens.read_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=80), st.lists(st.integers(0, 80), max_size=5))
def test_repaired_joins(text, places):
    cuts = sorted({0, len(text), *(min(p, len(text)) for p in places)})
    assert tokens.repaired_pieces([text[a:b] for a, b in zip(cuts, cuts[1:])]) == regex.findall(tokens.PATTERN, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(ALPHABET, max_size=200)), max_size=6))
def test_encoding_is_exact(texts):
    e = tokens.ChunkEncoder.of(tokens.read_vocabulary())
    offsets, ids = e.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [e.bpe.encode_ordinary(t) if t else [] for t in texts]


def test_long_stretches(encoder):
    r = random.Random(1)
    for text in ("中" * 20000, "ab" * 15000 + "'ll x", "".join(r.choice(ALPHABET) for _ in range(30000)), "x" * 9000 + "   y", "<|endoftext|>"):
        assert encoder.encode([text])[1].tolist() == encoder.bpe.encode_ordinary(text)
        assert "".join(tokens.any_cuts(text)) == text


def test_memo_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 10)
    words = [f"word{i} and word{i + 1} again" for i in range(200)]
    for w in words:
        assert encoder.encode([w])[1].tolist() == encoder.bpe.encode_ordinary(w)
    assert len(encoder.memo) < 100


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "a text", "x"), (2, None, "y"), (3, "", "z"), (1, "a text", "x"), (4, "  \n", None)], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect())
    assert got[0] == got[1] and got[2:4] == [(2, []), (3, [])] and got[4][1]
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert sorted(r.n_tokens for r in tokens.count_tokens(df, ["doc_id"]).collect())[:2] == [0, 0]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .\n#-`|é"), max_size=400), st.integers(1, 60), st.integers(-2, 70))
def test_pieces_cover_and_overlap(text, most, overlap):
    pieces = splitting.split_text(text, most, overlap)
    shared = max(0, overlap) if overlap < most else most // 2
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b - a <= most for a, b, _ in pieces)
    assert all(x[1] - y[0] == shared for x, y in zip(pieces, pieces[1:]))


def test_cuts_at_topic_change():
    a = "The cache keeps sessions warm. Sessions in the cache expire. The cache evicts sessions."
    b = "Invoices are printed monthly. Printed invoices go to customers. Customers pay invoices."
    text = f"{a}\n\n{b}"
    (_, end, kind), *_ = splitting.split_text(text, 130, 0)
    assert end == len(a) + 2 and kind == "paragraph"


def test_code_is_not_cut():
    text = "Intro sentence here.\n\n```\n" + "x = 1\n" * 8 + "```\n\n" + "After words. " * 8
    assert all(not 22 < end < text.rindex("```") + 3 for _, end, _ in splitting.split_text(text, 120, 10)[:-1])


SCHEMA = "repo string, id string, revision int, is_deleted boolean, raw_content string, sections struct<context: string, decision: string, considered_options: string>, item string, text string"


def test_oversized_items(spark):
    long = "Sentence one is here. " * 20
    rows = [
        ("r", "1", 1, False, long, (long, None, "short"), None, None), ("r", "1", 2, False, "now short", (long, "", None), "c", "c"), ("r", "1", 2, False, "now short", (long, "", None), None, None),
        ("r", "2", 1, False, long, None, None, None), ("r", "2", 2, True, None, None, None, None), ("r", "3", 1, False, None, None, None, None), (None, "4", None, False, long, None, None, None),
    ]
    limits = spark.createDataFrame([("raw_content", 100, 10), ("context", 100, None), ("decision", None, 5), ("other", 5, 1)], "item string, max_chars int, overlap_chars int")
    pieces = splitting.split_oversized(spark.createDataFrame(rows, SCHEMA), limits).collect()
    assert {(p.repo, p.id, p.item) for p in pieces} == {("r", "1", "context"), (None, "4", "raw_content")}
    assert all(len(p.text) <= 100 and p.text == long[p.start : p.end] for p in pieces)
    assert splitting.split_oversized(spark.createDataFrame([], SCHEMA), limits).count() == 0
    assert splitting.split_oversized(spark.createDataFrame(rows, SCHEMA), limits.limit(0)).count() == 0
