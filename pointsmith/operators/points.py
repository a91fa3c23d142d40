"""The data model: points as a DataFrame, a collection's configuration, vectors in their accepted forms."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from pointsmith.functions import vecmath as vm

DISTANCES = ("Cosine", "Euclidean", "Dot")
INDEX_TYPES = ("keyword", "integer", "float", "bool", "geo", "text")

POINTS = "id string, id_num bigint, version bigint, vector array<float>, multivector array<array<float>>, sparse map<string,struct<indices:array<bigint>,values:array<float>>>, payload string"


@dataclass
class CollectionConfig:
    name: str
    vector_dim: int = 128
    distance: str = "Cosine"
    index: str | None = None
    enable_bm25: bool = False
    payload_indexes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.distance not in DISTANCES:
            raise ValueError(f"distance must be one of {DISTANCES}")


def id_number(id_col: Column) -> Column:
    """The id as a number, null where it is none; ids from 2^63 wrap around."""
    n = F.when(F.rlike(id_col, F.lit("^[0-9]{1,20}$")), id_col.try_cast("decimal(20,0)"))
    wrapped = F.when(n >= F.lit(str(2**63)).cast("decimal(20,0)"), n - F.lit(str(2**64)).cast("decimal(21,0)")).otherwise(n)
    return wrapped.try_cast("bigint")


def as_points(df: DataFrame, key: str, vector: str | None = None) -> DataFrame:
    """A points view of a table: id, id_num, version, vector, and the table's own columns as the typed payload."""
    return df.select(F.col(key).cast("string").alias("id"), F.col(key).cast("bigint").alias("id_num"), F.lit(0).cast("bigint").alias("version"), (F.col(vector) if vector else F.lit(None).cast("array<float>")).alias("vector"), F.struct(*[c for c in df.columns if c != vector]).alias("payload"))


def parse_vector(value: object) -> dict:
    """A vector in any accepted form -> {vector, multivector, sparse}.

    Lists of numbers are dense, lists of lists multivectors, {indices, values} sparse; an object of names holds any of
    them, of which the last dense one counts and the sparse ones keep their names. Empty and null mean no vector.
    """
    out: dict = {"vector": None, "multivector": None, "sparse": None}
    if value is None or value == [] or value == {}:
        return out
    if isinstance(value, list):
        if isinstance(value[0], list):
            rows = [[float(x) for x in r] for r in value]
            if not rows[0] or any(len(r) != len(rows[0]) for r in rows):
                raise ValueError("multivector rows must be of one length above zero")
            return out | {"multivector": rows, "vector": rows[0]}
        return out | {"vector": [float(x) for x in value]}
    if isinstance(value, dict):
        if {"indices", "values"} <= value.keys():
            return out | {"sparse": {"default": _sparse(value)}, "vector": [0.0]}
        for name, own in value.items():
            if isinstance(own, dict):
                out["sparse"] = (out["sparse"] or {}) | {name: _sparse(own)}
            else:
                out |= {k: v for k, v in parse_vector(own).items() if v is not None}
        return out | ({"vector": [0.0]} if out["vector"] is None and out["sparse"] else {})
    raise ValueError(f"not a vector: {value!r}")


def _sparse(value: dict) -> dict:
    n = min(len(value["indices"]), len(value["values"]))
    return {"indices": [int(i) for i in value["indices"][:n]], "values": [float(x) for x in value["values"][:n]]}


def points_from_records(spark: SparkSession, records: list[dict], required: bool = False) -> DataFrame:
    """Points of request records {id, vector, payload}; required: a point without a vector is an error."""
    import json

    rows = []
    for r in records:
        v = parse_vector(r.get("vector"))
        if required and v["vector"] is None:
            raise ValueError(f"point {r.get('id')} has no vector")
        payload = r.get("payload")
        num = int(r["id"]) if str(r["id"]).isdigit() else None
        num = num - 2**64 if num is not None and num >= 2**63 else num
        rows.append((str(r["id"]), num, None, v["vector"], v["multivector"], v["sparse"], None if payload is None else json.dumps(payload, ensure_ascii=False)))
    return spark.createDataFrame(rows, POINTS)


def points_from_rpc(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Points of binary-protocol records {id, vectors, payload}: ids that look like numbers become numbers (so `007` is
    7), a missing vector is an error, and of named vectors the first dense one counts, in the order given."""
    rows = []
    for r in records:
        own, vectors = str(r["id"]), r.get("vectors", r.get("vector"))
        if own.isascii() and own.isdigit() and int(own) < 2**64:
            own = str(int(own))
        if isinstance(vectors, dict) and not {"indices", "values"} <= vectors.keys():
            dense = next((v for v in vectors.values() if isinstance(v, list)), None)
            sparse = {k: v for k, v in vectors.items() if isinstance(v, dict)}
            vectors = {**sparse, **({"": dense} if dense is not None else {})}
        rows.append({"id": own, "vector": vectors, "payload": r.get("payload")})
    return points_from_records(spark, rows, required=True)


def check_dimension(points: DataFrame, dim: int) -> DataFrame:
    """points, failing when a row with a vector of another length is read; 0 switches the check off."""
    if dim == 0:
        return points
    bad = F.col("vector").isNotNull() & (F.size("vector") != dim)
    return points.withColumn("vector", F.when(bad, F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {dim}, got "), F.size("vector").cast("string"))).cast("array<float>")).otherwise(F.col("vector")))


def score_column(vector: Column, query: list[float] | Column, distance: str = "Cosine", scoring: str = "true") -> Column:
    """The similarity of a vector to a query, larger is nearer.

    scoring 'true': cosine, minus Euclidean distance, or inner product. 'query_normalized': the query is brought to
    length one first, and Cosine is then the inner product with the stored vector.
    """
    if scoring == "query_normalized":
        if isinstance(query, list):
            n = math.sqrt(sum(x * x for x in query))
            query = [x / n for x in query] if n > vm.EPSILON else query
        else:
            query = vm.normalize(query)
    q = vm.literal_vector(query) if isinstance(query, list) else query
    if distance == "Euclidean":
        return F.lit(0.0) - vm.l2_distance(q, vector)  # no negative zero
    if distance == "Dot" or scoring == "query_normalized":
        return vm.dot(q, vector)
    return vm.cosine(q, vector)
