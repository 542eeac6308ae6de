"""Connected components of link tables, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempoweir.llm.common import cut, freed

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    with freed(edges.sparkSession):
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _exploded(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    made = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])
    return edges.select(F.explode(made).alias("e")).select("e.*")


def _round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step: larger, then smaller neighbours of each node hang on the least one.

    The least neighbours of the large star are cut, so that both sides of its join are
    plain exchanges: a hub's links lie in a skewed partition that Spark splits.  The
    small star groups a node's smaller neighbours, of which a hub of larger ones has few.
    """
    both = _exploded(edges, ("a", "b"), ("b", "a"))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return cut(_exploded(small, ("a", "m"), ("b", "m")).where("a > b").distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link, component being the least node reachable.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until the
    links form stars.  Nodes are aggregated, never listed, so a hub of any degree
    is spread over tasks; each round is cut through the shared folder.
    """
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b")
    edges = cut(pairs.distinct())
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        edges = _round(edges)
        after = _state(edges)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n = len(linked)
    free, found = np.ones(n, bool), []
    for start in range(n):
        if not free[start]:
            continue
        free[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(linked[i] & free)
            free[new] = False
            found += [(i, int(j)) for j in new]
            todo += new.tolist()
    return found
