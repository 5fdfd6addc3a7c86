"""Text functions as column expressions: tokens, phrases, shingles, entities and citations.

All of them stay in the JVM.  Patterns use ASCII classes and look-arounds, as Java's
word boundary follows Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning of their own.
STOP_WORDS = (
    "a about above after again against all am an and any are aren as at be because been before being below between both but by can could did do does doing down during each few for "
    "from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we "
    "were what when where which while who whom why with would you your yours yourself yourselves"
).split()
# Single words that are never a term.
GENERIC_WORDS = (
    "true false null undefined string number boolean object array todo fixme tbd status decision context consequences options proposed accepted rejected deprecated superseded"
).split()
# Acronym-shaped words that are none.
STOP_ACRONYMS = "THE AND FOR NOT ALL ANY BUT CAN NEW ADR".split()
# Technologies known by name.
TECHNOLOGIES = (
    r"kubernetes|k8s|consul|vault|postgres|postgresql|mysql|redis|kafka|rabbitmq|istio|envoy|helm|docker|podman|terraform|argocd|argo|prometheus|grafana|opentelemetry|otel|grpc|graphql|"
    r"azure|aws|gcp|google\s+cloud|azure\s+devops"
)
#: Blanks as JavaScript knows them.
BLANK = r"[\s ﻿]"


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits, ``-`` and ``_`` without these at their ends; nulls give no words.

    Edges are stripped on the whole text, not per word: patterns are the costly part.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_-]+", " ")
    bare = F.regexp_replace(bare, r"(?<![A-Za-z0-9])[-_]+|[-_]+(?![A-Za-z0-9])", "")
    return F.filter(F.split(F.lower(bare), " "), lambda w: w != "")


def tokenize(text: Column, sub_tokens: bool = True, split_bonded: bool = False) -> Column:
    """Search tokens: words of two letters and more that are no stop words.

    A bonded word (``service_mesh``) also gives its parts, unless ``sub_tokens`` is off.
    ``split_bonded`` treats ``_`` as a blank, so that only the parts remain.
    """
    source = F.regexp_replace(text, "_", " ") if split_bonded else text
    keep = lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS)
    tokens = F.filter(words(source), keep)
    if not sub_tokens or split_bonded:
        return tokens
    with_parts = F.flatten(F.transform(tokens, lambda w: F.when(F.contains(w, F.lit("_")), F.concat(F.array(w), F.filter(F.split(w, "_"), keep))).otherwise(F.array(w))))
    return F.when(F.contains(F.coalesce(text, F.lit("")), F.lit("_")), with_parts).otherwise(tokens)


def clean_phrase(text: Column) -> Column:
    """Lower case, only ASCII letters, digits, ``-``, ``_`` and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"[`*_~#\[\]()<>]", " "), r"[^a-z0-9\s_-]", " "), r"\s+", " "))


def bonded_token(phrase: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(phrase), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def display_name(phrase: Column) -> Column:
    """Initial capitals; words of up to four capitals stay as they are."""
    parts = F.filter(F.split(phrase, r"[\s_-]+"), lambda w: F.length(w) > 0)
    word = lambda w: F.when((F.length(w) <= 4) & (w == F.upper(w)), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(parts, word), " ")


def round_half_up(value: Column, digits: int) -> Column:
    """Rounding with halves toward plus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)) / scale


def pad4(digits: Column) -> Column:
    """Padded with zeros to four digits; longer numbers stay whole."""
    return F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))


def clean_prose(text: Column) -> Column:
    """Without fenced code, tags and table rules; single blanks."""
    t = F.regexp_replace(text, r"(?s)```.*?```", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"[|:-]{3,}", " ")
    return F.trim(F.regexp_replace(t, rf"{BLANK}+", " "))


def truncate_words(text: Column, most: int) -> Column:
    """The text if it has at most ``most`` words, else that many and ``...``."""
    parts = F.split(text, rf"{BLANK}+")
    return F.when(F.size(parts) <= most, text).otherwise(F.concat(F.array_join(F.slice(parts, 1, most), " "), F.lit("...")))


def entities(content: Column) -> Column:
    """Technical identifiers in order of kind: code spans, acronyms, known technologies, record numbers."""
    spans = F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"`([^`\n\r]+)`"), 1), lambda s: F.trim(s)), lambda s: F.length(s).between(2, 40) & ~F.contains(s, F.lit(" ")))
    acronyms = F.filter(F.regexp_extract_all(content, F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Z0-9_-]{1,10})(?![A-Za-z0-9_])"), 1), lambda a: ~a.isin(STOP_ACRONYMS))
    known = F.transform(F.regexp_extract_all(content, F.lit(rf"(?i)(?<![A-Za-z0-9_])({TECHNOLOGIES})(?![A-Za-z0-9_])"), 1), lambda t: F.regexp_replace(F.lower(t), r"\s+", "-"))
    numbers = F.transform(F.regexp_extract_all(content, F.lit(r"(?i)ADR[-:\s]*([0-9]{1,4})"), 1), lambda n: F.concat(F.lit("adr-"), pad4(n)))
    lower = lambda column: F.transform(column, lambda s: F.lower(s))
    return F.array_distinct(F.concat(lower(spans), lower(acronyms), known, numbers))


def citations(content: Column, own_id: Column) -> Column:
    """Numbers of other records that a text names, in order of first mention."""
    pattern = r"(?i)(?:legacy\s+adr[-:\s]*[0-9]{1,4}|adr[-:\s]*[0-9]{3,4}|(?:docs/adr|legacy_adr)/(?:adr-)?[0-9]{3,4})"
    numbers = F.transform(F.regexp_extract_all(content, F.lit(pattern), 0), lambda m: F.regexp_extract(m, r"([0-9]+)$", 1))
    return F.array_remove(F.array_distinct(numbers), F.coalesce(own_id, F.lit("")))
