"""Vocabulary harvest: candidate phrases from six extractors, admission, and bonding of phrases in texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Openings of sentences that are no phrases.
SENTENCE_STARTERS = (
    "in order", "because of", "this decision", "we recommend", "as a", "if the", "when the", "for example", "on the", "to ensure", "based on", "in addition", "due to", "such as",
    "with the", "at the", "it is", "there is", "there are",
)
#: Phrases that a bonding automaton may hold; it is broadcast, and a phrase has at most 50 characters.
MOST_PHRASES = 200_000


def shingles(text: Column) -> Column:
    """Bigrams and trigrams of neighbouring words inside clauses, none of them a stop or generic word."""
    stop = [*T.STOP_WORDS, *T.GENERIC_WORDS]
    clauses = F.split(F.coalesce(text, F.lit("")), r"[.!?;:\n\r|()\[\]{}\"]+")
    words = F.transform(clauses, lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s_-]", " "), r"\s+"), lambda w: F.length(w) > 0))
    plain = lambda ws: F.transform(ws, lambda w: ~w.isin(stop))

    def grams(pair: Column, n: int) -> Column:
        last = F.size(pair["w"]) - n
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        ok = F.filter(at, lambda i: F.forall(F.slice(pair["p"], i + 1, n), lambda x: x))
        return F.transform(ok, lambda i: F.array_join(F.slice(pair["w"], i + 1, n), " "))

    pairs = F.transform(words, lambda ws: F.struct(ws.alias("w"), plain(ws).alias("p")))
    return F.flatten(F.transform(pairs, lambda p: F.concat(grams(p, 2), grams(p, 3))))


def candidates(records: DataFrame, key: list[str]) -> DataFrame:
    """(key, ord, phrase, clean, source) of every emission; records need raw_content, metadata and sections.

    Phrases are cleaned before the explode: a filter on the clean form is then a look-up
    and isn't expanded into its patterns.
    """
    raw = F.coalesce("raw_content", F.lit(""))
    all_ = lambda pattern, group=1: F.regexp_extract_all(raw, F.lit(pattern), group)
    spans = F.filter(F.transform(all_(r"`([^`\n\r]+)`"), lambda s: F.trim(s)), lambda s: F.length(s).between(2, 45))
    headers = F.transform(all_(r"(?m)^#{1,3}[ \t]+([^\r\n]+)$"), lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, r"(?i)^ADR[-:\s]*[0-9]{1,4}[:\s-]*", ""), r"[:|()]", " ")))
    options = F.transform(all_(r"(?i)(?:Option|\* Option|\+ Option|- Option)[ \t]+[0-9]+:[ \t]*([^\n\r]+)"), lambda o: F.trim(F.regexp_replace(o, "[\"`]", "")))
    acronyms = F.filter(all_(r"(?<![A-Za-z0-9_])([a-z]{1,2}[A-Z]{2,}|[A-Z][A-Z0-9_-]{1,8})(?![A-Za-z0-9_])"), lambda a: ~a.isin(T.STOP_ACRONYMS))
    titles = all_(r"(?<![A-Za-z0-9_])([A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+){1,3})(?![A-Za-z0-9_])")
    prose = F.concat_ws("\n", "metadata.title", "sections.context", "sections.decision", "sections.considered_options")
    tagged = lambda values, source: F.transform(values, lambda v: F.struct(v.alias("phrase"), T.clean_phrase(v).alias("clean"), F.lit(source).alias("source")))
    whole = F.concat(
        tagged(spans, "code_span"), tagged(headers, "header"), tagged(F.flatten(F.transform(headers, shingles)), "header"), tagged(options, "option_title"),
        tagged(F.flatten(F.transform(options, shingles)), "option_title"), tagged(acronyms, "acronym"), tagged(titles, "title_case"), tagged(shingles(prose), "clause_shingle"),
    )
    return records.select(*key, F.posexplode(whole).alias("ord", "c")).select(*key, "ord", "c.phrase", "c.clean", "c.source")


def harvest(records: DataFrame, key: list[str] | None = None, order: str = "doc_ord") -> DataFrame:
    """Admitted terms: (term, raw_phrase, display_name, doc_count, total_occurrences, sources).

    Phrases have 2 to 50 characters and 1 to 4 words.  A term is admitted if a code
    span, header, option title or acronym gave it; else with several words if two
    records or three emissions have it, with one word if two records have it.
    Emissions are counted per term and record before the shuffle by term, so common
    phrases don't gather in one task.
    """
    key = key or ["repo", "id"]
    rows = candidates(records, key)
    n_words = F.size(F.split("clean", " "))
    single = [*T.STOP_WORDS, *T.GENERIC_WORDS]
    kept = rows.where(F.length("clean").between(2, 50) & n_words.between(1, 4) & ~((n_words == 1) & F.col("clean").isin(single)) & ~F.col("clean").isin(list(SENTENCE_STARTERS)) & F.col("clean").rlike("[a-z0-9]"))
    termed = kept.withColumn("term", T.bonded_token(F.col("clean"))).where("term <> ''")
    per_record = termed.groupBy("term", *key).agg(F.count(F.lit(1)).alias("n"), F.collect_set("source").alias("s"), F.min(F.struct("ord", "clean")).alias("first"))
    total = per_record.groupBy("term").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("n").alias("total_occurrences"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("sources"), F.min(F.struct(*key, "first")).alias("f")
    )
    phrase = F.col("f.first.clean")
    several = F.size(F.split(phrase, " ")) >= 2
    structural = F.arrays_overlap("sources", F.array(*[F.lit(s) for s in ("code_span", "header", "option_title", "acronym")]))
    admitted = structural | (several & ((F.col("doc_count") >= 2) | (F.col("total_occurrences") >= 3))) | (~several & (F.col("doc_count") >= 2))
    return total.where(admitted).select("term", phrase.alias("raw_phrase"), T.display_name(phrase).alias("display_name"), "doc_count", "total_occurrences", "sources")


def top_terms(vocabulary: DataFrame, min_docs: int = 1, limit: int = 50) -> DataFrame:
    return vocabulary.where(F.col("doc_count") >= min_docs).orderBy(F.desc("doc_count"), F.desc("total_occurrences"), "term").limit(limit)


def lookup(vocabulary: DataFrame, term_or_phrase: str) -> DataFrame:
    return vocabulary.where(F.col("term") == T.bonded_token(F.lit(term_or_phrase)))


def bond(texts: DataFrame, vocabulary: DataFrame, column: str = "text", most: int = MOST_PHRASES) -> DataFrame:
    """Replace admitted phrases of several words by their bonded terms, longest first, at word bounds, in any case.

    Up to ``most`` phrases make one automaton that is broadcast; its size is bounded by
    that number.  With more, the n-grams of the distinct texts meet the phrases by a join.
    """
    several = vocabulary.where(F.contains("raw_phrase", F.lit(" "))).select("raw_phrase", "term")
    phrases = several.limit(most + 1).collect()
    if len(phrases) > most:
        return _bond_by_join(texts, several, column)
    held = texts.sparkSession.sparkContext.broadcast({r["raw_phrase"]: r["term"] for r in phrases})
    at = texts.columns.index(column)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        longest = max((p.count(" ") + 1 for p in held.value), default=0)
        for pdf in batches:
            name = pdf.columns[at]
            yield pdf.assign(**{name: [bond_text(t, held.value, longest) for t in pdf[name]]})

    return texts.mapInPandas(run, texts.schema)


def _bond_by_join(texts: DataFrame, phrases: DataFrame, column: str) -> DataFrame:
    """As `bond`, each text with the phrases that occur in it, found by a shuffle of its n-grams."""
    longest = phrases.agg(F.max(F.size(F.split("raw_phrase", " "))).alias("n")).first()["n"] or 0
    at = texts.columns.index(column)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["t"]:
                words = [m.group().lower() for m in _WORD.finditer(text)]
                found = {" ".join(words[i : i + n]) for n in range(2, longest + 1) for i in range(len(words) - n + 1)}
                if found:
                    yield pd.DataFrame({"t": text, "raw_phrase": sorted(found)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, out = pdf["_phrases"], pdf.drop(columns="_phrases")
            name = out.columns[at]
            maps = [{p["raw_phrase"]: p["term"] for p in ps} if ps is not None else {} for ps in held]
            yield out.assign(**{name: [bond_text(t, m, longest) for t, m in zip(out[name], maps)]})

    keyed = texts.withColumn("_hash", F.sha2(column, 256))
    distinct = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("t")).distinct()
    met = distinct.mapInPandas(grams, "t string, raw_phrase string").select(F.sha2("t", 256).alias("_hash"), "raw_phrase").join(phrases, "raw_phrase")
    per_text = met.groupBy("_hash").agg(F.collect_list(F.struct("raw_phrase", "term")).alias("_phrases"))
    joined = keyed.join(per_text, "_hash", "left").select(*texts.columns, "_phrases")
    return joined.mapInPandas(run, texts.schema)


_WORD = re.compile(r"[A-Za-z0-9_-]+")


def bond_text(text: str | None, phrases: dict[str, str], longest: int) -> str | None:
    if not text or not phrases:
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at, i = [], 0, 0
    while i < len(spans):
        for n in range(min(longest, len(spans) - i), 1, -1):
            start, end = spans[i][0], spans[i + n - 1][1]
            if all(not text[spans[k][1] : spans[k + 1][0]].strip() for k in range(i, i + n - 1)):
                term = phrases.get(" ".join(text[a:b].lower() for a, b in spans[i : i + n]))
                if term:
                    out += [text[at:start], term]
                    at, i = end, i + n - 1
                    break
        i += 1
    return "".join([*out, text[at:]])
