"""Counts, facets and document listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import filtered


def count(points: DataFrame, flt: dict | None = None, exact: bool = True, get=None, id_col: str = "id") -> DataFrame:
    """One row, `count`. exact is accepted; counts are always exact."""
    return filtered(points, flt, get, id_col).agg(F.count(F.lit(1)).alias("count"))


def facet(points: DataFrame, key, limit: int = 10, flt: dict | None = None, get=None, id_col: str = "id", exact: bool = True) -> DataFrame:
    """(value, count) of the most frequent values of a scalar field (a name, or a Column of text), ties by value."""
    value = F.col(key) if isinstance(key, str) else key
    kept = filtered(points, flt, get, id_col).select(value.cast("string").alias("value")).where("value is not null")
    if not exact:
        top = kept.agg(F.expr(f"approx_top_k(value, {limit}, {max(1000, 20 * limit)})").alias("t"))
        return top.select(F.inline("t")).select(F.col("item").alias("value"), "count").orderBy(F.desc("count"), "value")
    return kept.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def json_facet_key(column: str, path: str):
    """A facet key in JSON text: scalars as the text has them; objects, lists and null are no values."""
    own = F.get_json_object(F.col(column), path)
    return F.when(~F.rlike(own, F.lit(r"^\s*[\[{]")), own)


def list_documents(points: DataFrame, document: str, id_col: str = "id") -> DataFrame:
    """(document, chunks, ids): chunks of each document, ids in order."""
    return points.groupBy(F.col(document).alias("document")).agg(F.count(F.lit(1)).alias("chunks"), F.array_sort(F.collect_list(id_col)).alias("ids"))


def max_id(points: DataFrame, id_col: str = "id_num") -> DataFrame:
    return points.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("max_id"))
