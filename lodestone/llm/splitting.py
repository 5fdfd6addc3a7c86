"""Splitting oversized items at natural boundaries by lexical cohesion.

A text is first read into units that end at natural boundaries: before a heading,
after a paragraph or code block, before a list item or table row, after a sentence.
Code blocks are one unit each.  Blocks of units before and after every boundary are
compared by the cosine of their word counts; a boundary's depth is how far that
similarity falls below the peaks on either side.  In each size window the boundary
with the greatest depth (plus a bonus for its kind) is the cut, and the next piece
starts ``overlap_chars`` before it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS = ("raw_content", "context", "decision", "considered_options")
#: Units on each side of a boundary that are compared.
BLOCK = 4
#: What a kind of boundary adds to the depth (which lies in 0..2).
BONUS = {"heading": 0.6, "paragraph": 0.3, "code": 0.3, "list": 0.15, "sentence": 0.0}
#: A cut lies in the last part of its window where there is any boundary, so that pieces aren't needlessly many.
LEAST_FILL = 0.5

_HEADING = re.compile(r"\s{0,3}#{1,6}\s|\s*<h[1-6]\b|\s*h[1-6]\.\s|\s*={2,6}[^=].*={2,6}\s*$|\s*\\(?:sub)*section\b|\s*\\chapter\b", re.I)
_ITEM = re.compile(r"\s*(?:[-*+•]\s|\d{1,3}[.)]\s|<li\b|\\item\b|\||#\s|<tr\b)", re.I)
_FENCE = re.compile(r"\s*(```|~~~)")
_OPEN = re.compile(r"\s*(?:<pre\b|\\begin\{(?:verbatim|lstlisting|minted)|\{code|\{noformat|<syntaxhighlight|<source\b)", re.I)
_CLOSE = re.compile(r"</pre>|\\end\{(?:verbatim|lstlisting|minted)|\{code\}\s*$|\{noformat\}\s*$|</syntaxhighlight>|</source>", re.I)
_SENTENCE = re.compile(r"[.!?…](?:[\"')\]]|</\w+>)*\s+|[。！？]|</(?:p|li|td|tr|div)>\s*", re.I)
_WORD = re.compile(r"[^\W\d_]{3,}")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")


@dataclass
class Boundary:
    at: int
    kind: str
    depth: float = 0.0


def natural_boundaries(text: str) -> list[Boundary]:
    """Places inside the text where it may be cut, in order; none lie inside a code block."""
    found: dict[int, str] = {}
    rank = list(BONUS)

    def add(at: int, kind: str) -> None:
        if 0 < at < len(text) and (at not in found or rank.index(kind) < rank.index(found[at])):
            found[at] = kind

    fence, code, blank = "", False, False
    for m in _LINE.finditer(text):
        line, start, end = m.group(), m.start(), m.end()
        if not line:
            continue
        mark = _FENCE.match(line)
        if fence:
            if mark and mark.group(1) == fence:
                fence = ""
                add(end, "code")
            continue
        if code:
            if _CLOSE.search(line):
                code = False
                add(end, "code")
            continue
        if mark:
            fence = mark.group(1)
            add(start, "code")
        elif _OPEN.match(line):
            add(start, "code")
            code = not _CLOSE.search(_OPEN.sub("", line, count=1))
            if not code:
                add(end, "code")
        elif not line.strip():
            blank = True
            continue
        else:
            if _HEADING.match(line):
                add(start, "heading")
            elif blank:
                add(start, "paragraph")
            elif _ITEM.match(line):
                add(start, "list")
            for s in _SENTENCE.finditer(line):
                add(start + s.end(), "sentence")
        blank = False
    return [Boundary(at, found[at]) for at in sorted(found)]


def depths(text: str, bounds: list[Boundary]) -> None:
    """Set each boundary's depth from the cohesion of the units around it."""
    if not bounds:
        return
    edges = [0, *(b.at for b in bounds), len(text)]
    units = [Counter(_WORD.findall(text[a:b].lower())) for a, b in zip(edges, edges[1:])]
    sims = []
    for i in range(len(bounds)):
        before, after = sum(units[max(0, i + 1 - BLOCK) : i + 1], Counter()), sum(units[i + 1 : i + 1 + BLOCK], Counter())
        norm = sqrt(sum(v * v for v in before.values()) * sum(v * v for v in after.values()))
        sims.append(sum(v * after[w] for w, v in before.items() if w in after) / norm if norm else 0.0)
    left, right = list(sims), list(sims)  # the peak that a climb to either side reaches
    for i in range(1, len(sims)):
        left[i] = left[i - 1] if sims[i - 1] >= sims[i] else sims[i]
    for i in range(len(sims) - 2, -1, -1):
        right[i] = right[i + 1] if sims[i + 1] >= sims[i] else sims[i]
    for b, peak, other, sim in zip(bounds, left, right, sims):
        b.depth = (peak - sim) + (other - sim)


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces as (start, end, kind of the cut at the end), in code points.

    A text within the limit is one piece.  Every piece is within it; consecutive ones
    share exactly ``overlap`` characters; together they cover the text.  An overlap of
    the limit or more is lowered to half of it, a negative one to 0; a limit below 1 is 1.
    """
    max_chars = max(1, int(max_chars))
    overlap = max(0, int(overlap)) if overlap < max_chars else max_chars // 2
    if len(text) <= max_chars:
        return [(0, len(text), "end")]
    bounds = natural_boundaries(text)
    depths(text, bounds)
    at = np.array([b.at for b in bounds], np.int64)
    pieces, start = [], 0
    while len(text) - start > max_chars:
        last = start + max_chars
        for least in (start + max(overlap + 1, int(max_chars * LEAST_FILL)), start + overlap + 1):
            window = bounds[np.searchsorted(at, least) : np.searchsorted(at, last, side="right")] if bounds else []
            if window:
                break
        if window:
            best = max(window, key=lambda b: (b.depth + BONUS[b.kind], b.at))
            end, kind = best.at, best.kind
        else:
            line, gap = text.rfind("\n", start + overlap, last), text.rfind(" ", start + overlap, last)
            end, kind = (line + 1, "line") if line >= 0 else (gap + 1, "word") if gap >= 0 else (last, "limit")
        pieces.append((start, end, kind))
        start = end - overlap
    return [*pieces, (start, len(text), "end")]


def oversized_items(parsed: DataFrame, limits: DataFrame) -> DataFrame:
    """Items of live records' current rows that are longer than their limit, once each.

    Which revision counts is found from the key columns alone; of the texts only the
    oversized ones are shuffled, so the size of a normal record doesn't matter.  Null
    texts, items without a limit and null limits give no rows.
    """
    bound = {r["item"]: (r["max_chars"], r["overlap_chars"] or 0) for r in limits.where(F.col("max_chars").isNotNull() & F.col("item").isin(*ITEMS)).groupBy("item").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("l")).select("item", "l.*").collect()}
    schema = "repo string, id string, item string, text string, max_chars int, overlap_chars int"
    if not bound:
        return parsed.sparkSession.createDataFrame([], schema)
    current = parsed.groupBy("repo", "id").agg(F.max(F.struct("revision", (F.col("is_deleted") == F.lit(False)).alias("live"))).alias("c"))
    current = current.where("c.live").select("repo", "id", F.col("c.revision").alias("revision"))
    column = lambda item: F.col("raw_content" if item == "raw_content" else f"sections.{item}")
    big = [
        F.when(F.length(column(i)) > m, F.struct(F.lit(i).alias("item"), column(i).alias("text"), F.lit(m).alias("max_chars"), F.lit(o).alias("overlap_chars")))
        for i, (m, o) in bound.items()
    ]
    rows = parsed.select("repo", "id", "revision", F.explode(F.filter(F.array(*big), lambda x: x.isNotNull())).alias("x"))
    kept = rows.join(current, (rows.repo.eqNullSafe(current.repo)) & (rows.id.eqNullSafe(current.id)) & (rows.revision.eqNullSafe(current.revision)), "left_semi")
    return kept.groupBy("repo", "id", F.col("x.item").alias("item")).agg(F.max("x").alias("x")).select("repo", "id", "item", "x.text", "x.max_chars", "x.overlap_chars")


_PIECE = "repo string, id string, item string, piece int, n_pieces int, start int, end int, cut string, text string"


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            pieces = split_text(r.text, r.max_chars, r.overlap_chars)
            out += [(r.repo, r.id, r.item, k, len(pieces), a, b, cut, r.text[a:b]) for k, (a, b, cut) in enumerate(pieces)]
        yield pd.DataFrame(out, columns=["repo", "id", "item", "piece", "n_pieces", "start", "end", "cut", "text"])


def split_oversized(parsed: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every oversized item: (repo, id, item, piece, n_pieces, start, end, cut, text).

    ``cut`` names the boundary at the piece's end (heading, paragraph, code, list,
    sentence, else line, word or limit, and end).  An item is split where its record's
    current row lies; no item is gathered with another.
    """
    return oversized_items(parsed, limits).mapInPandas(_split, _PIECE)
