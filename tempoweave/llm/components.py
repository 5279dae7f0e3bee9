"""Connected components of a table of links, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoweave.llm._store import forget, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (a, b) of linked ids to rows (a, b): each id a that has a link, but the least of its component, and that least id b.

    Alternates the large-star and small-star operations of Kiveris et al.
    (2014) until the links are stars; each round is written to the shared folder.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(now)
    while True:
        # large star: larger neighbours of every id move to its least neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hubs = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-least")  # so that a hub's rows can be split in the join
        large = both.filter("b > a").join(hubs, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: an id and its smaller neighbours move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        after = written(small, name)
        forget(now, hubs)
        now = after
        before, state = state, _state(now)
        if before == state:
            return now
