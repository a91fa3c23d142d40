"""Scroll by key, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import filtered


def scroll(points: DataFrame, offset: int | tuple | None = None, limit: int = 10, flt: dict | None = None, id_num: str = "id_num", id_col: str = "id", get=None) -> DataFrame:
    """The `limit` points after offset by numeric id, then id, ids that are no numbers last; a key-set page, so its
    cost does not grow with the offset. offset: the last id_num seen, or (id_num, id) where id_num may be None."""
    kept = filtered(points, flt, get, id_col)
    if isinstance(offset, tuple):
        num, own = offset
        after = F.col(id_num).isNull() & (F.col(id_col) > F.lit(own)) if num is None else (F.col(id_num) > num) | ((F.col(id_num) == num) & (F.col(id_col) > F.lit(own))) | F.col(id_num).isNull()
        kept = kept.where(after)
    elif offset is not None:
        kept = kept.where((F.col(id_num) > offset) | F.col(id_num).isNull())
    return kept.orderBy(F.asc_nulls_last(id_num), id_col).limit(limit)


def scroll_page(points: DataFrame, offset=None, limit: int = 10, flt: dict | None = None, id_num: str = "id_num", id_col: str = "id", get=None) -> tuple[list, object]:
    """A page's rows and the next offset, None at the end: asks for one row more than the page holds."""
    rows = scroll(points, offset, limit + 1, flt, id_num, id_col, get).collect()
    page = rows[:limit]
    return page, (page[-1][id_num], page[-1][id_col]) if len(rows) > limit else None


def get_by_ids(points: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """The points of these ids in the order asked for, with `position`; unknown ids are passed over."""
    kind = points.schema[id_col].dataType
    asked = points.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"position int, `{id_col}` {kind.simpleString()}")
    # Short lists reach the scan as a predicate; long ones are joined, without a hint, by their size.
    few = len(ids) <= 500
    kept = points.where(F.col(id_col).isin(list(ids))) if few else points
    return kept.join(F.broadcast(asked) if few else asked, id_col).orderBy("position")
