"""Okapi BM25 over chunks of text, for many queries at once.

Postings are a long table (chunk, term, tf, length).  Frequencies, lengths and scores
are aggregates with partial sums before every shuffle; a term that occurs in most
chunks is spread over salts when queries meet postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS
from lodestone.operators.search import top_k
from lodestone.session import hot_key_join, materialize, spread

K1, B = 1.2, 0.75
#: Query terms up to which they are broadcast to the postings (some 10 MB); beyond, both sides are shuffled by term.
BROADCAST_TERMS = 200_000


def _meet(rows: DataFrame, weights: DataFrame, terms: DataFrame, on: str) -> DataFrame:
    """Rows of the index with the weights of asked terms.

    Few query terms go to where the postings lie: a chunk's postings lie together, so
    its sums are complete before the shuffle.  Many meet by a join on the term.
    """
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return rows.join(F.broadcast(weights), "term")
    return hot_key_join(rows, weights, "term", "df", on)


#: Lower case for ASCII letters; whatever is no letter, digit, ``-`` or ``_`` is a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c in b"-_" else 32 for c in range(256))
_STOPPED = frozenset(STOP_WORDS)
#: Words whose tokens a worker remembers.
MEMO = 500_000


def _tokens(word: bytes) -> list[str]:
    """The search tokens of a folded word, as `text.tokenize` has them: itself without ``-_`` at its ends, and the parts of a bonded one."""
    keep = lambda w: len(w) >= 2 and w not in _STOPPED
    whole = word.decode().strip("-_")
    return [whole, *(filter(keep, whole.split("_")) if "_" in whole else ())] if keep(whole) else []


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text, the last column, by its number of tokens, distinct tokens in order of first occurrence, and their counts."""
    memo: dict[bytes, list[int]] = {}
    codes: dict[str, int] = {}
    for b in batches:
        flat, counts, offsets, lengths = [], [], [0], []
        for text in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist():
            found: dict[int, int] = {}
            for word, n in Counter((text or b"").translate(_FOLD).split()).items():
                if (own := memo.get(word)) is None:
                    own = memo[word] = [codes.setdefault(t, len(codes)) for t in _tokens(word)]
                for c in own:
                    found[c] = found.get(c, 0) + n
            flat.extend(found)
            counts.extend(found.values())
            offsets.append(len(flat))
            lengths.append(sum(found.values()))
        at = pa.array(offsets, pa.int32())
        terms = pa.array(list(codes), pa.string()).take(pa.array(flat, pa.int32()))
        columns = [*b.columns[:-1], pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "length", "terms", "tfs"])
        if len(memo) > MEMO:
            memo, codes = {}, {}


def pack(df: DataFrame) -> DataFrame:
    """One row per text, the last column: (..., length, terms, tfs).  In Python, as patterns and lambdas in the JVM take some ten times as long."""
    return df.mapInArrow(_pack, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]), "length int", "terms array<string>", "tfs array<bigint>"]))


@dataclass(frozen=True)
class Index:
    """Postings (chunk_id, doc_id, section_type, length, term, tf), term frequencies (term, df) and totals (n, avg_length).

    ``packed`` has the postings as one row per chunk, with arrays ``terms`` and ``tfs``;
    in a stored index no chunk_id repeats with the same length.  ``whole``: a chunk is a document.
    """

    postings: DataFrame
    frequencies: DataFrame
    totals: DataFrame
    packed: DataFrame
    whole: bool = False


_KEYS = ["chunk_id", "doc_id", "section_type", "length"]


def _postings(packed: DataFrame) -> DataFrame:
    return packed.select(*_KEYS, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))


def _frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def build(chunks: DataFrame, chunk: str = "chunk_id", doc: str = "doc_id", section: str | None = None, text: str = "text") -> Index:
    """Index chunks of text.  Null texts are no chunks; texts without tokens count with length 0."""
    named = chunks.where(F.col(text).isNotNull()).select(*dict.fromkeys([chunk, doc, text, *([section] if section else [])]))
    packed = pack(spread(named).select(F.col(chunk).alias("chunk_id"), F.col(doc).alias("doc_id"), (F.col(section) if section else F.lit(None)).cast("string").alias("section_type"), F.col(text)))
    totals = packed.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))
    postings = _postings(packed).groupBy(*_KEYS, "term").agg(F.sum("tf").alias("tf"))
    return Index(postings, _frequencies(postings), totals, packed, chunk == doc)


def idf(n: F.Column, df: F.Column) -> F.Column:
    return F.when(n > 0, F.log((n - df + 0.5) / (df + 0.5) + 1)).otherwise(F.lit(0.0))


def idf_table(index: Index) -> DataFrame:
    """(term, df, idf) of every term."""
    return index.frequencies.crossJoin(index.totals).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # totals is one row


def query_terms(queries: DataFrame, text: str = "text", key: str = "query_id") -> DataFrame:
    """(query_id, term, ord): the distinct tokens of each query in order."""
    packed = pack(queries.select(F.col(key).alias("query_id"), F.col(text)))
    return packed.select("query_id", F.posexplode("terms").alias("ord", "term"))


def stored(index: Index) -> Index:
    """The index as tables in the shared folder: every later use reads them instead of tokenising again."""
    packed = materialize(index.packed, "packed")
    totals = materialize(packed.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length")), "totals")
    if packed.groupBy("chunk_id").count().where("count > 1").limit(1).count():
        merged = _postings(packed).groupBy(*_KEYS, "term").agg(F.sum("tf").alias("tf"))
        merged = merged.groupBy(*_KEYS).agg(F.collect_list(F.struct("term", "tf")).alias("p"))
        packed = materialize(merged.select(*_KEYS, F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs")), "packed")
    postings = _postings(packed)
    return Index(postings, materialize(_frequencies(postings), "frequencies"), totals, packed, index.whole)


def score(index: Index, terms: DataFrame, k1: float = K1, b: float = B, section: str | None = None) -> DataFrame:
    """(query_id, chunk_id, doc_id, section_type, score) of every chunk with a query term.

    Frequencies and lengths are those of all chunks, whatever the section filter.  Sums
    only: which terms matched is found for the rows that are kept, by `matched_terms`.
    """
    postings = index.postings if section is None else index.postings.where(F.col("section_type") == section)
    asked = terms.groupBy("term").agg(F.collect_list("query_id").alias("asked"))
    weights = asked.join(index.frequencies, "term").crossJoin(index.totals)  # totals is one row
    weights = weights.select("term", "asked", "df", idf(F.col("n"), F.col("df")).alias("idf"), "avg_length")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.when(F.col("avg_length") > 0, F.col("avg_length")).otherwise(1.0)))
    hits = _meet(postings, weights, terms, "chunk_id").select("chunk_id", "doc_id", "section_type", part.alias("part"), F.explode("asked").alias("query_id"))
    return hits.groupBy("query_id", "chunk_id", "doc_id", "section_type").agg(F.sum("part").alias("score"))


def matched_terms(index: Index, terms: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``matched_terms``, in the query's order, to rows of (query_id, chunk_id, ...)."""
    chosen = rows.select("chunk_id").distinct()
    if chosen.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:  # else all chunks are shuffled
        chosen = F.broadcast(chosen)
    held = index.packed.select("chunk_id", F.col("terms").alias("held")).join(chosen, "chunk_id", "left_semi")
    held = held.groupBy("chunk_id").agg(F.flatten(F.collect_list("held")).alias("held"))
    asked = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("asked"))
    both = rows.join(held, "chunk_id", "left").join(asked, "query_id", "left")
    return both.withColumn("matched_terms", F.array_intersect("asked.term", "held")).drop("held", "asked")


def attribution(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, term, tf, idf, weight): which query terms a document answers, over all its chunks."""
    per_doc = index.postings.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    asked = terms.groupBy("term").agg(F.collect_list("query_id").alias("asked"))
    weights = asked.join(index.frequencies, "term").crossJoin(index.totals).select("term", "asked", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    hits = _meet(per_doc, weights, terms, "doc_id")
    return hits.select(F.explode("asked").alias("query_id"), "doc_id", "term", "tf", "idf", (F.col("idf") * F.col("tf")).alias("weight"))


def _round(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _entries(b: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in the vocabulary and tf of the postings in a packed batch whose terms are in the vocabulary."""
    terms, tfs = b.column(b.schema.get_field_index("terms")), b.column(b.schema.get_field_index("tfs"))
    at = pc.index_in(terms.flatten(), vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    known = np.flatnonzero(at >= 0)
    row = np.repeat(np.arange(b.num_rows), np.diff(terms.offsets.to_numpy()))
    return row[known], at[known], tfs.flatten().to_numpy(zero_copy_only=False)[known]


def _first(group: np.ndarray, weight: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first k of their group, by descending weight and rank, in order; and their place from 0."""
    order = np.lexsort((rank, -weight, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[place < k], place[place < k]


def _first_documents(index: Index, weights: DataFrame, k: int, digits: int) -> DataFrame:
    """(term, df, doc_id, tf, idf, weight): at least the first k documents of each term of ``weights``, of each batch those that can be among them."""
    held = weights.toArrow().combine_chunks()
    sent = index.packed.sparkSession.sparkContext.broadcast((held["term"].combine_chunks() if len(held) else pa.array([], pa.string()), held["df"].to_numpy(), held["idf"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, df, idfs = sent.value
        least = np.full(len(vocabulary), -np.inf)
        for b in batches:
            row, term, tf = _entries(b, vocabulary)
            weight = _round(idfs[term] * tf, digits)
            can = np.flatnonzero(weight >= least[term])
            rank = pc.rank(b.column(0), tiebreaker="dense").to_numpy().astype(np.int64)
            kept, place = _first(term[can], weight[can], rank[row[can]], k)
            kept = can[kept]
            last = kept[place == k - 1]
            least[term[last]] = weight[last]
            t = term[kept]
            yield pa.RecordBatch.from_arrays([vocabulary.take(pa.array(t)), pa.array(df[t]), b.column(0).take(pa.array(row[kept])), pa.array(tf[kept]), pa.array(idfs[t]), pa.array(weight[kept])], ["term", "df", "doc_id", "tf", "idf", "weight"])

    return index.packed.select("doc_id", "terms", "tfs").mapInArrow(run, f"term string, df bigint, doc_id {index.packed.schema['doc_id'].dataType.simpleString()}, tf bigint, idf double, weight double")


def best_attribution(index: Index, terms: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The first k rows of `attribution` per query, by weight of ``digits`` digits (descending), doc_id and term.

    A term's documents come in the same order for every query that asks for it, so only
    its first k can be among any query's: each term is cut before queries meet documents.
    """
    terms = materialize(terms.select("query_id", "term"), "terms")
    weights = terms.select("term").distinct().join(index.frequencies, "term").crossJoin(index.totals).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # totals is one row
    if index.whole and terms.select("term").distinct().limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        rows = _first_documents(index, weights, k, digits)
    else:
        per_doc = index.postings.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
        rows = _meet(per_doc, weights, terms.select("term").distinct(), "doc_id").select("term", "df", "doc_id", "tf", "idf", F.round(F.col("idf") * F.col("tf"), digits).alias("weight"))
    first = top_k(rows, "term", [F.desc("weight"), F.asc("doc_id")], k)
    packed = first.groupBy("term", "df").agg(F.collect_list(F.struct("doc_id", "tf", "idf", "weight")).alias("first"))
    hits = hot_key_join(terms, packed, "term", "df", "query_id").select("query_id", F.col("term"), F.inline("first"))
    return top_k(hits.select("query_id", "doc_id", "term", "tf", "idf", "weight"), "query_id", [F.desc("weight"), F.asc("doc_id"), F.asc("term")], k)
