"""Connected components of a link table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Links of a partition, about: small link tables don't run in as many tasks as the texts they come from.
PART = 50_000


def _pairs(*pairs: tuple[Column, Column]) -> Column:
    return F.inline(F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in pairs]))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b: long); component is the smallest id reachable.

    Each round links every id's neighbours, and the id itself, to the least of them all, until the links are stars.
    It is an aggregation by id, which sums up before it shuffles and also tells whether the links are stars, a join
    with its result, which has a row an id and whose other side Spark can split, and a distinct; so the hub of a large
    component is no task's burden.  Rounds are checkpointed and grow with the logarithm of the longest path.  Self
    links and nulls drop out.
    """
    links = edges.where(F.col("a") != F.col("b")).select("a", "b")
    for _ in range(most_rounds):
        both = links.select(_pairs((F.col("a"), F.col("b")), (F.col("b"), F.col("a"))))
        known = both.groupBy("a").agg(F.min("b").alias("lo"), F.max(F.when(F.col("b") < F.col("a"), F.col("b"))).alias("hi"), F.max("b").alias("top"))
        known = checkpoint(known)
        odd = (F.col("lo") < F.col("a")) & ((F.col("hi") != F.col("lo")) | (F.col("top") > F.col("a")))
        n, left = known.agg(F.count("*"), F.count_if(odd)).first()
        if not left:
            return known.select(F.col("a").alias("id"), F.least("a", "lo").alias("component"))
        least = known.select("a", F.least("a", "lo").alias("m"))
        links = both.join(least, "a").select(_pairs((F.col("b"), F.col("m")), (F.col("a"), F.col("m")))).where("a <> b").distinct()
        links = checkpoint(links).coalesce(max(1, n // PART))
    raise RuntimeError("links did not become stars")
