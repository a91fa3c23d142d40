"""Connected components of a link table, by alternating large-star and small-star steps over DataFrames.

Every step is one aggregate and one join on the links; a hub's links are aggregated before they meet, and nothing is
collected but counts of the links. Lineage is cut at a table in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointsmith.session import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = links.union(links.selectExpr("b AS a", "a AS b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are linked to the smallest of them."""
    down = links.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").selectExpr("b AS a", "m AS b").union(least.selectExpr("a", "m AS b")).where("a <> b").distinct()


#: Links that one task writes, about: tables of few links are not spread over many files.
LINKS_A_TASK = 250_000


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link, to a node without any: then that node is the smallest of its component."""
    n = links.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("sources")).first()
    return n["n"] == n["sources"] and links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """links (a, b) of any orderable ids -> (node, class): the smallest id of each component; isolated ids don't appear.

    Null ids and self-links are passed over; repeated links count once; an empty table gives an empty result.
    """
    spark = links.sparkSession
    now = cut(spark, links.toDF("a", "b").where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    files = max(1, -(-now.count() // LINKS_A_TASK))
    for _ in range(most_rounds):
        if _are_stars(now):
            return now.selectExpr("a AS node", "b AS class").union(now.selectExpr("b AS node", "b AS class")).distinct()
        now = cut(spark, _small_star(_large_star(now)).coalesce(files))
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
