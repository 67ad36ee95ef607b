"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertline.session import stored

HUB_SHARE = 1000  # a node of more than one in so many links is a hub


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Label both ends of links with the smallest node that can be reached: ``node``, ``component``.

    ``links`` has two long columns ``a`` and ``b``. Nodes without a link to another node are not listed;
    links with a null end count as none. Each round hangs the larger neighbours of every node on its
    smallest neighbour, then its smaller ones, until every node hangs on the root of its component.
    That takes about log(n) rounds. All is aggregation and joins of two-column tables, a node with
    very many links is combined before the shuffle and joined by broadcast, and each round is written to the
    shared folder.
    """
    edges = _distinct(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    edges = stored(edges, name)
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_large_star(edges, mark[0]), name)
        edges = stored(_small_star(edges, edges.count()), name)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _distinct(edges: DataFrame) -> DataFrame:
    """Links from the larger to the smaller node, once each."""
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Add ``m``, the smallest neighbour, to links (a, b).

    ``least`` has a row (a, m, n) per node, ``n`` being the number of its links among ``total``. The nodes with a
    large share of them, HUB_SHARE at most, are broadcast, so that the links of a hub stay where they are.
    """
    hubs = F.broadcast(least.filter(F.col("n") * HUB_SHARE > total).select("a", "m"))
    others = least.filter(F.col("n") * HUB_SHARE <= total).select("a", "m")
    return rows.join(hubs, "a").unionByName(rows.join(hubs.select("a"), "a", "left_anti").join(others, "a"))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.select("a", F.least("a", "m").alias("m"), "n")
    far = _with_least(both.filter("b > a"), least, 2 * count)
    return far.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    rest = _with_least(edges, least, count).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _distinct(rest.unionByName(least.select("a", F.col("m").alias("b"))))
