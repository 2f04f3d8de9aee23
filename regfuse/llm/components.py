"""Pairwise matches consolidated into groups: connected components by seed-tree pruning.

Every round each vertex of the remaining graph is connected to the minimum of its neighbourhood; a vertex that is
no one's minimum then has nothing left to tell: it leaves the graph and hangs below its own minimum in a
propagation forest. Only minima remain, joined through the vertices that knew several of them, so the graph
shrinks by a large factor a round and long chains fold up in logarithmically many rounds. When no edge is left,
the roots (seeds) name their groups, and names flow down the forest, the last round's vertices first.

Scale: edges are deduplicated before every shuffle, minima are partial aggregates, and the only joins meet a table
with one row a vertex, so a hub that holds a third of all edges is split by adaptive execution on the edge side.
Each round is written to the shared folder; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfuse.session import Cut

#: A graph of 2**60 vertices needs fewer rounds; more mean a fault.
MAX_ROUNDS = 60


def connected_groups(links: DataFrame, one: str, other: str, vertex: str = "vertex", group: str = "group") -> DataFrame:
    """One row for each vertex of ``links`` with the smallest vertex (byte order) it is linked to over any chain.

    ``links`` holds undirected links between the columns ``one`` and ``other`` of equal type. Repeated and mirrored
    links count once; a link of a vertex to itself makes it a vertex; rows with a null on either side are ignored;
    an empty table gives an empty result. Other columns of ``links`` are not read."""
    pairs = links.select(F.col(one).alias("u"), F.col(other).alias("v")).filter("u is not null and v is not null")
    # edges as (larger, smaller), self links kept once to keep their vertex
    edges = Cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    vertices = edges.df
    graph, forest, first = edges, [], True
    for round_no in range(MAX_ROUNDS):
        proper = graph.df.filter("u <> v")
        both = proper.union(proper.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each vertex tells its neighbourhood and itself the minimum: (vertex, minimum it heard of)
        told = both.join(low, "u").select(F.col("v").alias("x"), "m").union(low.select(F.col("u").alias("x"), "m"))
        heard = Cut(told.distinct(), f"heard{round_no}")
        if not heard.rows:
            heard.drop()
            break
        best = heard.df.groupBy("x").agg(F.min("m").alias("best"), F.max((F.col("m") == F.col("x")).cast("int")).alias("seed"))
        best = Cut(best, f"best{round_no}")
        # a vertex that is no one's minimum leaves; it hangs below the least it heard of
        forest.append((best, best.df.filter("seed = 0").select(F.col("x").alias("child"), F.col("best").alias("parent"))))
        rest = heard.df.join(best.df.select("x", "best"), "x").filter("m <> best").select(F.col("m").alias("u"), F.col("best").alias("v"))
        nxt = Cut(rest.distinct(), f"edges{round_no}")
        heard.drop()
        if not first:
            graph.drop()
        first, graph = False, nxt
    else:
        raise RuntimeError("the graph did not shrink")
    if not first:
        graph.drop()

    every = vertices.select(F.col("u").alias("x")).union(vertices.select("v")).distinct()
    children = None
    for _, t in forest:
        children = t.select("child") if children is None else children.union(t.select("child"))
    named = Cut((every if children is None else every.join(children, every["x"] == children["child"], "left_anti")).select("x", F.col("x").alias("g")), "roots")
    for i, (best, t) in enumerate(reversed(forest)):
        down = t.join(named.df, t["parent"] == named.df["x"]).select(F.col("child").alias("x"), "g")
        step = Cut(named.df.unionByName(down), f"named{i}")
        named.drop()
        best.drop()
        named = step
    edges.drop()
    return named.df.select(F.col("x").alias(vertex), F.col("g").alias(group))


def trimmed(c: str):
    """A text without blanks of any kind around it; null if nothing is left."""
    t = F.regexp_replace(F.col(c), r"^[\s\u00a0\u200b\ufeff]+|[\s\u00a0\u200b\ufeff]+$", "")
    return F.when(t != "", t)


def match_groups(matches: DataFrame) -> DataFrame:
    """Every identifier of ``matches`` with both sides present and the smallest identifier of its group."""
    links = matches.select(trimmed("projectid").alias("a"), trimmed("other_projectid").alias("b"))
    return connected_groups(links, "a", "b", "projectid", "group_projectid")
