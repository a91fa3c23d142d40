"""Chat tools: a tool's arguments become a filter and one operator call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import aggregate, mutate, paging, search, text_search


def filter_of(conditions: dict | None) -> dict | None:
    """{field: value, list of values, or range {gt, gte, lt, lte}} -> a filter of all of them; nothing -> no filter."""
    must = []
    for key, want in (conditions or {}).items():
        if isinstance(want, dict):
            must.append({"key": key, "range": want})
        elif isinstance(want, (list, tuple)):
            must.append({"key": key, "match": {"any": list(want)}})
        else:
            must.append({"key": key, "match": {"value": want}})
    return {"must": must} if must else None


class Tools:
    """The tools over one collection. embedder: text -> vector, for vector search by text."""

    def __init__(self, points: DataFrame, embedder: Callable[[str], list[float]] | None = None, id_col: str = "id", id_num: str = "id_num", text_col: str = "text", distance: str = "Cosine", get=None):
        self.points, self.embedder, self.id_col, self.id_num, self.text_col, self.distance, self.get = points, embedder, id_col, id_num, text_col, distance, get

    def vector_search(self, query: str | list[float], conditions: dict | None = None, limit: int = 10) -> DataFrame:
        if isinstance(query, str):
            if self.embedder is None:
                raise ValueError("vector search by text needs an embedder")
            query = self.embedder(query)
        return search.knn(self.points, query, limit, self.distance, filter_of(conditions), id_col=self.id_col, get=self.get)

    def text_search(self, query: str, conditions: dict | None = None, limit: int = 10) -> DataFrame:
        return text_search.bm25(self.points, query, limit, self.text_col, self.id_col, flt=filter_of(conditions), get=self.get)

    def get_facets(self, field, conditions: dict | None = None, limit: int = 10) -> DataFrame:
        return aggregate.facet(self.points, field, limit, filter_of(conditions), self.get, self.id_col)

    def recommend(self, positive: list, negative: list | None = None, conditions: dict | None = None, limit: int = 10) -> DataFrame:
        return search.recommend(self.points, positive, negative, limit, self.distance, filter_of(conditions), id_col=self.id_col, get=self.get)

    def find_similar(self, point_id: object, conditions: dict | None = None, limit: int = 10) -> DataFrame:
        return search.knn_by_id(self.points, point_id, limit, self.distance, filter_of(conditions), id_col=self.id_col, get=self.get)

    def filter_records(self, conditions: dict | None = None, limit: int = 10, offset=None) -> DataFrame:
        return paging.scroll(self.points, offset, limit, filter_of(conditions), self.id_num, self.id_col, self.get)

    def count_records(self, conditions: dict | None = None) -> DataFrame:
        return aggregate.count(self.points, filter_of(conditions), get=self.get, id_col=self.id_col)

    def delete_records(self, conditions: dict) -> DataFrame:
        """The points that are left. Without any condition nothing is deleted."""
        flt = filter_of(conditions)
        return mutate.delete_by_filter(self.points, flt, self.get, self.id_col) if flt else self.points

    def get_record(self, point_id: object) -> DataFrame:
        return paging.get_by_ids(self.points, [point_id], self.id_col)

    def explore(self, n: int = 10) -> tuple[DataFrame, DataFrame]:
        """The first n rows, and the row count."""
        return self.filter_records(limit=n), self.count_records()
