"""Reciprocal-rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rrf(legs: list[DataFrame], limit: int = 10, k: int = 1) -> DataFrame:
    """(id, score): the sum over legs of 1 / (rank + k), rank from 1. Legs (id, score) are top lists, so one task ranks each."""
    ranked = [leg.select("id", (1.0 / (F.row_number().over(Window.orderBy(F.desc("score"), "id")) + k)).alias("part")) for leg in legs]
    fused = reduce(DataFrame.unionByName, ranked).groupBy("id").agg(F.sum("part").alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(limit)
