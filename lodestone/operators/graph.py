"""Typed relationship graph of records: edges, traversals from many sources at once, and validation.

Nodes are (repo, id); ids are unique only within a repository.  Edges are one table
in their forward types; the inverse view swaps the ends.  Traversals advance a
frontier of (source, node) pairs, drop what was visited by an anti join, and cut
lineage at every level through a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.records import status_word
from lodestone.operators.references import padded_number
from lodestone.session import materialize

# Relations and their inverses.
INVERSE = {"OBSOLETES": "OBSOLETED_BY", "EXTENDS": "EXTENDED_BY", "AMENDS": "AMENDED_BY", "DEPENDS_ON": "REQUIRED_BY", "REFERENCES": "REFERENCED_BY"}
#: List of a record's metadata to relation, and whether the record is its target.
LISTS = (("supersedes", "OBSOLETES", False), ("superseded_by", "OBSOLETES", True), ("extends", "EXTENDS", False), ("amends", "AMENDS", False), ("depends_on", "DEPENDS_ON", False), ("required_by", "DEPENDS_ON", True))
#: Levels whose tables are merged into one, so that plans don't grow with the depth.
MERGE_LEVELS = 16


def current(parsed: DataFrame) -> DataFrame:
    """Live records that are no legacy files, one row each, with number, title, status word, date and lists."""
    lists = [F.col(f"metadata.{name}").alias(name) for name, _, _ in LISTS]
    newest = F.max(F.struct("revision", (F.col("is_deleted") == F.lit(False)).alias("live"), "doc_ord", F.col("metadata.title").alias("title"), F.col("metadata.status").alias("status"), F.col("metadata.date").alias("date"), F.col("metadata.category").alias("category"), "file_path", "inline_references", *lists))
    rows = parsed.groupBy("repo", "id").agg(newest.alias("c")).where("c.live").select("repo", "id", "c.*")
    return rows.where(~F.coalesce(F.contains("file_path", F.lit("legacy")), F.lit(False))).withColumn("status_word", status_word(F.col("status")))


def nodes(records: DataFrame) -> DataFrame:
    """(repo, id, title, status, date, category, doc_ord); the id is the canonical number."""
    number = F.coalesce(padded_number(F.col("id")), F.col("id"))
    best = F.min_by(F.struct("title", F.col("status_word").alias("status"), "date", "category", "doc_ord"), F.struct("doc_ord", "id"))
    return records.groupBy("repo", number.alias("id")).agg(best.alias("b")).select("repo", "id", "b.*")


def edges(records: DataFrame) -> DataFrame:
    """(repo, source, target, type, explicit): distinct edges in forward types.

    Six metadata lists give explicit edges; an inline citation gives REFERENCES unless
    the record has another edge to the same target or names itself.  References
    without digits are no edges.  Citations to records that don't exist are dropped,
    explicit edges to them are kept (they dangle).
    """
    own = F.coalesce(padded_number(F.col("id")), F.col("id"))

    def ends(relation: str, reverse: bool) -> Callable[[Column], Column]:
        return lambda v: F.struct(F.lit(relation).alias("type"), padded_number(v).alias("other"), F.lit(reverse).alias("back"))

    named = [F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), ends(relation, reverse)) for name, relation, reverse in LISTS]
    explicit = records.select("repo", own.alias("own"), F.explode(F.concat(*named)).alias("e")).where(F.col("e.other").isNotNull())
    explicit = explicit.select("repo", F.when(F.col("e.back"), F.col("e.other")).otherwise(F.col("own")).alias("source"), F.when(F.col("e.back"), F.col("own")).otherwise(F.col("e.other")).alias("target"), F.col("e.type").alias("type")).distinct()
    cited = records.select("repo", own.alias("source"), F.explode("inline_references").alias("v")).select("repo", "source", padded_number(F.col("v")).alias("target"), F.lit("REFERENCES").alias("type"))
    known = nodes(records).select("repo", F.col("id").alias("target"))
    cited = cited.where("target <> source").distinct().join(known, ["repo", "target"], "left_semi").join(explicit.select("repo", "source", "target"), ["repo", "source", "target"], "left_anti")
    return explicit.withColumn("explicit", F.lit(True)).unionByName(cited.withColumn("explicit", F.lit(False)))


def with_inverse(edge: DataFrame) -> DataFrame:
    """All edges in both directions, the backward ones under their inverse types."""
    inverse = F.create_map(*[x for pair in INVERSE.items() for x in map(F.lit, pair)])[F.col("type")]
    return edge.unionByName(edge.select("repo", F.col("target").alias("source"), F.col("source").alias("target"), inverse.alias("type"), "explicit"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def traverse(starts: DataFrame, step: DataFrame, levels: int | None = None) -> DataFrame:
    """(repo, start, id, depth, type): nodes reached from each start by ``step`` (repo, source, target, type).

    Depth is the least number of steps, type that of the edge by which the node was
    first reached (of several the smallest in name).  A start is not reached by itself;
    cycles end.  Every level is one join, one aggregate and one anti join; there are as
    many as it takes until nothing new is reached, or ``levels``.
    """
    step = materialize(step.select("repo", F.col("source").alias("id"), F.col("target").alias("next"), "type"), "step")
    frontier = starts.select("repo", F.col("id").alias("start"), "id").distinct()
    seen = materialize(frontier.withColumn("depth", F.lit(0)).withColumn("type", F.lit(None).cast("string")), "level")
    frontier = seen
    reached = [seen]
    for depth in count(1) if levels is None else range(1, levels + 1):
        found = frontier.join(step.withColumnRenamed("type", "by"), ["repo", "id"]).groupBy("repo", "start", F.col("next").alias("id")).agg(F.min("by").alias("type"))
        if len(reached) == MERGE_LEVELS:
            reached = [materialize(_union(reached), "reached")]
        fresh = found.join(_union(reached).select("repo", "start", "id"), ["repo", "start", "id"], "left_anti")
        frontier = materialize(fresh.select("repo", "start", "id", F.lit(depth).alias("depth"), "type"), "level")
        if frontier.isEmpty():
            break
        reached.append(frontier)
    return _union(reached).where("depth > 0")


def dependencies(starts: DataFrame, edge: DataFrame, node: DataFrame) -> DataFrame:
    """Upstream records of each start over DEPENDS_ON, EXTENDS and AMENDS, with title, status and depth."""
    reached = traverse(starts, edge.where(F.col("type").isin("DEPENDS_ON", "EXTENDS", "AMENDS")))
    told = reached.join(node.select("repo", "id", "title", "status"), ["repo", "id"], "left")
    status = F.coalesce("status", F.lit("unknown"))
    return told.select("repo", "start", "id", F.coalesce("title", "id").alias("title"), status.alias("status"), F.col("type").alias("relation"), "depth", status.isin("deprecated", "superseded").alias("outdated"))


def impact(starts: DataFrame, edge: DataFrame) -> DataFrame:
    """Downstream counts of each start: direct, extensions, citations, transitive (depth 2 and more) and the blast score."""
    back = edge.select("repo", F.col("target").alias("source"), F.col("source").alias("target"), "type")
    reached = traverse(starts, back.where(F.col("type").isin("DEPENDS_ON", "EXTENDS", "AMENDS")))
    deep = reached.groupBy("repo", "start").agg(F.count(F.when(F.col("depth") >= 2, 1)).alias("transitive"))
    n = lambda *types: F.count(F.when(F.col("type").isin(*types), 1))
    near = back.groupBy("repo", F.col("source").alias("start")).agg(n("DEPENDS_ON").alias("direct"), n("EXTENDS", "AMENDS").alias("extensions"), n("REFERENCES").alias("citations"))
    all_ = starts.select("repo", F.col("id").alias("start")).distinct().join(near, ["repo", "start"], "left").join(deep, ["repo", "start"], "left").fillna(0, ["direct", "extensions", "citations", "transitive"])
    return all_.withColumn("score", 3 * F.col("direct") + 2 * F.col("extensions") + 1.5 * F.col("transitive"))


def ancestors(starts: DataFrame, edge: DataFrame) -> DataFrame:
    """All records that a start replaces, directly or through others: (repo, start, id, depth)."""
    return traverse(starts, edge.where("type = 'OBSOLETES'")).drop("type")


def successors(edge: DataFrame) -> DataFrame:
    """(repo, id, next, relation): what replaces a record, else what amends it; of several the smallest number."""
    rank = F.when(F.col("type") == "OBSOLETES", 0).otherwise(1)
    best = F.min(F.struct(rank.alias("r"), F.col("source").alias("next"))).alias("b")
    rows = edge.where(F.col("type").isin("OBSOLETES", "AMENDS")).groupBy("repo", F.col("target").alias("id")).agg(best)
    return rows.select("repo", "id", "b.next", F.when(F.col("b.r") == 0, "OBSOLETED_BY").otherwise("AMENDED_BY").alias("relation"))


def _jumps(step: DataFrame) -> tuple[DataFrame, bool]:
    """(repo, id, to, n, least): where each node of ``step`` (repo, id, next) ends, after how many steps, and the least node passed.

    Steps are doubled each round, so a chain takes the logarithm of its length.  A node
    without a step is an end; nodes that meet a cycle stay on it, and the second value
    tells whether there are any.
    """
    at = materialize(step.select("repo", "id", F.col("next").alias("to"), F.lit(1).alias("n"), F.least("id", "next").alias("least")), "jump")
    ids = step.select("repo", F.col("id").alias("to"))
    open_, length = at.join(ids, ["repo", "to"], "left_semi").count(), 1
    before = None
    # as many open nodes as a round before: they all meet cycles, and after as many steps as there are nodes they are on them
    while open_ and not (open_ == before and length >= open_):
        ahead = at.select("repo", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("least").alias("least2"))
        at = materialize(at.join(ahead, ["repo", "to"], "left").select("repo", "id", F.coalesce("to2", "to").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.least("least", "least2").alias("least")), "jump")
        open_, before, length = at.join(ids, ["repo", "to"], "left_semi").count(), open_, 2 * length
    return at, open_ > 0


def lineage(starts: DataFrame, edge: DataFrame) -> DataFrame:
    """(repo, start, active, steps): each start's chain of successors to its end; a chain stops before it repeats."""
    step = materialize(successors(edge).select("repo", "id", "next"), "successors")
    ends, looped = _jumps(step)
    ends = ends.select("repo", "id", F.col("to").alias("active"), F.col("n").alias("steps"))
    if looped:
        ring = materialize(ends.join(step.select("repo", F.col("id").alias("active")), ["repo", "active"], "left_semi").select("repo", F.col("active").alias("id")).distinct(), "ring")
        inside = step.join(ring, ["repo", "id"], "left_semi")
        named = _jumps(inside)[0].select("repo", "id", F.col("least").alias("ring"))
        # the entry of a cycle ends the walk at the node before it, after a round less one step
        last = inside.select("repo", F.col("next").alias("id"), F.col("id").alias("last")).join(named, ["repo", "id"]).join(named.groupBy("repo", "ring").agg((F.count(F.lit(1)) - 1).cast("int").alias("more")), ["repo", "ring"])
        outside = _jumps(step.join(ring, ["repo", "id"], "left_anti"))[0].select("repo", "id", F.col("to").alias("entry"), F.col("n"))
        walks = outside.unionByName(ring.select("repo", "id", F.col("id").alias("entry"), F.lit(0).alias("n")))
        walks = walks.join(last.select("repo", F.col("id").alias("entry"), "last", "more"), ["repo", "entry"], "left")
        ends = walks.select("repo", "id", F.coalesce("last", "entry").alias("active"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("steps"))
    asked = starts.select("repo", F.col("id").alias("start"), "id").distinct()
    return asked.join(ends, ["repo", "id"], "left").select("repo", "start", F.coalesce("active", "id").alias("active"), F.coalesce("steps", F.lit(0)).alias("steps"))


def neighborhood(starts: DataFrame, edge: DataFrame, radius: int = 1) -> DataFrame:
    """Nodes within ``radius`` edges of each start, whatever the direction."""
    return traverse(starts, with_inverse(edge), radius).select("repo", "start", "id", "depth")


def cycles(edge: DataFrame) -> DataFrame:
    """(repo, type, id, component): nodes on cycles of OBSOLETES or DEPENDS_ON, with the least node of their cycle.

    Nodes without an edge in or out are peeled off until none is left to peel; what
    remains is closed over reachability, and nodes that reach each other are one cycle.
    """
    rest = materialize(edge.where(F.col("type").isin("OBSOLETES", "DEPENDS_ON")).select("repo", "type", "source", "target").distinct(), "cycle")
    n = rest.count()
    while n:
        heads, tails = rest.select("repo", "type", F.col("target").alias("source")).distinct(), rest.select("repo", "type", F.col("source").alias("target")).distinct()
        rest = materialize(rest.join(heads, ["repo", "type", "source"], "left_semi").join(tails, ["repo", "type", "target"], "left_semi"), "cycle")
        n, before = rest.count(), n
        if n == before:
            break
    keyed = rest.select(F.concat_ws("\u0001", "repo", "type").alias("repo"), "source", "target", F.lit("x").alias("type"))
    reach = traverse(keyed.select("repo", F.col("source").alias("id")), keyed).select("repo", "start", "id")
    # a start on a cycle reaches one of its predecessors
    loop = keyed.select("repo", F.col("source").alias("id"), F.col("target").alias("start")).join(reach.unionByName(keyed.select("repo", F.col("source").alias("start"), F.col("source").alias("id"))).distinct(), ["repo", "start", "id"], "left_semi")
    on = loop.select("repo", "start").distinct()
    both = reach.join(reach.select("repo", F.col("start").alias("id"), F.col("id").alias("start")), ["repo", "start", "id"], "left_semi")
    least = on.join(both, ["repo", "start"], "left").groupBy("repo", "start").agg(F.least(F.min("id"), F.first("start")).alias("component"))
    parts = F.split("repo", "\u0001")
    return least.select(parts[0].alias("repo"), parts[1].alias("type"), F.col("start").alias("id"), "component")


def issues(edge: DataFrame, node: DataFrame) -> DataFrame:
    """(repo, code, severity, id, other): dangling ends, contradicting and split statuses, and orphans."""
    ids = node.select("repo", "id")
    explicit = edge.where("explicit")
    dangling = [
        explicit.join(ids.withColumnRenamed("id", end), ["repo", end], "left_anti").select("repo", F.lit(code).alias("code"), F.lit("error").alias("severity"), F.col("source").alias("id"), F.col("target").alias("other"))
        for end, code in (("target", "DANGLING_TARGET"), ("source", "DANGLING_SOURCE"))
    ]
    of = lambda end: node.select("repo", F.col("id").alias(end), F.col("status").alias(f"{end}_status"))
    pair = edge.join(of("source"), ["repo", "source"]).join(of("target"), ["repo", "target"])
    contradiction = pair.where("source_status = 'accepted' AND type IN ('EXTENDS', 'DEPENDS_ON') AND target_status IN ('superseded', 'deprecated')").select("repo", F.lit("STATUS_CONTRADICTION").alias("code"), F.lit("warning").alias("severity"), F.col("source").alias("id"), F.col("target").alias("other"))
    split = pair.where("source_status = 'accepted' AND type = 'OBSOLETES' AND target_status = 'accepted'").select("repo", F.lit("SPLIT_BRAIN").alias("code"), F.lit("error").alias("severity"), F.col("target").alias("id"), F.col("source").alias("other"))
    linked = edge.select("repo", F.col("source").alias("id")).unionByName(edge.select("repo", F.col("target").alias("id"))).distinct()
    orphan = ids.join(linked, ["repo", "id"], "left_anti").select("repo", F.lit("ORPHAN_RECORD").alias("code"), F.lit("warning").alias("severity"), "id", F.lit(None).cast("string").alias("other"))
    out = dangling[0]
    for more in (dangling[1], contradiction.distinct(), split, orphan):
        out = out.unionByName(more)
    return out


def aliases(node: DataFrame) -> DataFrame:
    """(repo, alias, id): the spellings by which a node is known; of several nodes the last in order wins."""
    bare = F.regexp_replace("id", "^0+(?=.)", "")
    spelled = F.array_distinct(F.array(F.lower("id"), F.concat(F.lit("adr-"), F.lower("id")), bare, F.concat(F.lit("adr-"), bare)))
    return node.select("repo", "id", "doc_ord", F.explode(spelled).alias("alias")).groupBy("repo", "alias").agg(F.max_by("id", F.struct("doc_ord", "id")).alias("id"))


def diagram(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(repo, mermaid): a flow chart per repository, nodes first, then edges, in order of their ids.

    One repository's lines meet in one row: the chart is one text by nature.
    """
    safe = lambda c: F.concat(F.lit("N_"), F.regexp_replace(c, "[^A-Za-z0-9_]", "_"))
    title = F.substring(F.regexp_replace(F.coalesce("title", F.lit("")), r"[\"\[\]()]", ""), 1, 35)
    box = node.select("repo", F.lit(0).alias("part"), F.col("id").alias("o1"), F.lit("").alias("o2"), F.concat(F.lit("    "), safe("id"), F.lit('["ADR-'), "id", F.lit("<br/>"), title, F.lit("<br/>("), F.coalesce("status", F.lit("")), F.lit(')"]:::target')).alias("line"))
    arrow = F.create_map(*[F.lit(x) for x in ("OBSOLETES", "-->|obsoletes|", "EXTENDS", "-.->|extends|", "AMENDS", "-.->|amends|", "DEPENDS_ON", "==>|requires|", "REFERENCES", "-.->|cites|")])
    ends = edge.join(node.select("repo", F.col("id").alias("source")), ["repo", "source"], "left_semi").join(node.select("repo", F.col("id").alias("target")), ["repo", "target"], "left_semi")
    link = ends.select("repo", F.lit(1).alias("part"), F.col("source").alias("o1"), F.concat_ws("|", "target", "type").alias("o2"), F.concat(F.lit("    "), safe("source"), F.lit(" "), arrow[F.col("type")], F.lit(" "), safe("target")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "o1", "o2", "line"))), lambda x: x["line"])
    return box.unionByName(link).groupBy("repo").agg(F.concat(F.lit("flowchart TD\n"), F.array_join(lines, "\n")).alias("mermaid"))

