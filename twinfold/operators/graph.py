"""Connected components of a graph of links, by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import scratch, stage


def _star(links: DataFrame) -> DataFrame:
    """One round on links (u, v) with u > v: first every v gives way to its smallest neighbour, then each u and its smaller neighbours are tied to the least of these."""
    low = links.select(F.col("v").alias("x"), F.col("v").alias("m")).unionByName(links.select(F.col("u").alias("x"), F.col("v").alias("m"))).groupBy("x").agg(F.min("m").alias("m"))
    wide = links.join(low.withColumnRenamed("x", "v"), "v").select("u", F.col("m").alias("v")).distinct()
    least = wide.groupBy("u").agg(F.min("v").alias("m"))
    tied = wide.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.withColumnRenamed("m", "v")).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """Links (a, b) of numbers with the components of edges: each node of a task's part with the least one of the part. Dense parts have far fewer of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        over: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := over.setdefault(x, x)) != x:
                over[x] = x = over[up]
            return x

        for t in batches:
            t = t[t.a != t.b].drop_duplicates()
            for x, y in zip(t.a.tolist(), t.b.tolist(), strict=True):
                u, v = top(x), top(y)
                if u != v:
                    over[max(u, v)] = min(u, v)
        yield pd.DataFrame({"a": over.keys(), "b": [top(x) for x in over]}, dtype="int64")

    return edges.mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, label): label is the smallest node that a chain of links reaches.

    Alternating large-star and small-star rounds, each a written table, until every component is one star around
    its smallest node; there are never more links than at first. A node with very many links is a skewed key
    of a sort-merge join, which adaptive execution splits, and is aggregated before the shuffle. Null ends
    and loops are ignored; nodes without links are not in the result.
    """
    mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    with scratch():
        links = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        before, after = None, links.agg(*mark).first()
        while after != before:
            links = stage(_star(links), "links")
            before, after = after, links.agg(*mark).first()
        nodes = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
        return stage(nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels", outer=True)
