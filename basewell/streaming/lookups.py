"""A stream of queries against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import match


def best_matches(queries: DataFrame, nested: DataFrame) -> DataFrame:
    """query_id, qpos, key, ref_id, rpos, dist, ties of a streaming (or static) queries(query_id, qpos, key, flank).

    Each query meets its whole range in one row, so there is no state and no watermark."""
    met = queries.join(nested.select("key", "values"), "key")
    best = met.select("query_id", "qpos", "key", match.nearest_in(F.col("values"), F.col("flank")).alias("best"))
    ties = F.size("best").cast("long")
    return best.select("query_id", "qpos", "key", ties.alias("_n"), F.explode("best").alias("v")).select("query_id", "qpos", "key", "v.ref_id", F.col("v.pos").alias("rpos"), "v.dist", F.when(F.col("v.dist").isNotNull(), F.col("_n")).alias("ties"))
