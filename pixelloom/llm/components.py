"""Connected components of links by alternating large-star and small-star contractions.

Both steps are a minimum for each vertex (partial aggregates first) and a join back on the
vertex, whose other side is unique, so a vertex with very many links can be split.  Each
pass is cut by a table in the shared folder; passes end when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import discard, stored


def _mark(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()


def components(links: DataFrame) -> DataFrame:
    """(u, v) from links (a, b) of longs: v is the smallest vertex of u's component, u <> v; roots are not listed."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e, "links")
    before = _mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        last, e = e, stored(small.where("u <> v").distinct(), "links")
        discard(last)
        after = _mark(e)
        if after == before:
            break
        before = after
    return e
