"""Mutations: each takes the current points and returns the next ones; tables swap them in as a new version.

Upserts are one full-outer-style rewrite by id (an aggregate, no self-join); deletes by id list are an anti-join,
by filter a predicate. Versions count a point's writes, from 0, per occurrence within a batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.window import Window

from .filters import Columns, certain, compile_filter


def upsert(current: DataFrame, incoming: DataFrame, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """The latest write of each id. incoming's order_col says which of its rows for one id is last (else any).

    For repeated ids in one batch give an order: without one it is that of partitions.
    """
    order = F.col(order_col).cast("bigint") if order_col else F.monotonically_increasing_id()
    cols = [c for c in current.columns if c != "version"]
    old = current.select(*cols, (F.col("version") if "version" in current.columns else F.lit(0)).cast("bigint").alias("version"), F.lit(None).cast("bigint").alias("__ord"))
    missing = [c for c in cols if c not in incoming.columns]
    new = incoming.select(*[F.col(c).cast(current.schema[c].dataType) if c not in missing else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in cols], F.lit(None).cast("bigint").alias("version"), order.alias("__ord"))
    both = old.unionByName(new)
    # One aggregate: the row of the last write, the old version, and the number of writes; partial sums leave the map side.
    row = F.struct(*[c for c in cols if c != id_col])
    last = both.groupBy(id_col).agg(F.max_by(row, F.coalesce("__ord", F.lit(-(2**62)))).alias("__row"), F.max("version").alias("__old"), F.count("__ord").alias("__writes"))
    version = F.when(F.col("__old").isNull(), F.col("__writes") - 1).otherwise(F.col("__old") + F.col("__writes")).cast("bigint")
    return last.select(*[F.col(id_col) if c == id_col else F.col("__row")[c].alias(c) for c in cols], version.alias("version"))


def _chosen(points: DataFrame, ids: list | None, flt: dict | None, get, id_col: str) -> Column:
    """The rows an edit applies to: these ids, and the filter; neither means all."""
    own = F.lit(True) if ids is None else F.col(id_col).cast("string").isin([str(i) for i in ids])
    return own & compile_filter(flt, get or Columns(points.schema), id_col) if flt else own


def delete_by_ids(points: DataFrame, ids: list | DataFrame, id_col: str = "id") -> DataFrame:
    """points without these ids; a frame of ids is anti-joined."""
    if isinstance(ids, DataFrame):
        return points.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_anti").select(*points.columns)
    return points.where(~F.coalesce(F.col(id_col).cast("string").isin([str(i) for i in ids]), F.lit(False)))


def delete_by_filter(points: DataFrame, flt: dict, get=None, id_col: str = "id") -> DataFrame:
    return points.where(~certain(compile_filter(flt, get or Columns(points.schema), id_col)))


def _edit(points: DataFrame, changes: dict[str, Column], chosen: Column) -> DataFrame:
    return points.withColumns({c: F.when(chosen, v.cast(points.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def set_payload(points: DataFrame, values: dict, ids: list | None = None, flt: dict | None = None, get=None, id_col: str = "id", payload: str | None = None) -> DataFrame:
    """Shallow merge of values into the payload: plain columns, or a struct or JSON-text column named `payload`."""
    chosen = _chosen(points, ids, flt, get, id_col)
    if payload is None:
        return _edit(points, {k: F.lit(v) for k, v in values.items()}, chosen)
    kind = points.schema[payload].dataType
    if kind.typeName() == "struct":
        new = reduce(lambda c, kv: c.withField(kv[0], F.lit(kv[1])), values.items(), F.col(payload))
        return points.withColumn(payload, F.when(chosen, new).otherwise(reduce(lambda c, k: c if k in kind.fieldNames() else c.withField(k, F.lit(None)), values, F.col(payload))))
    return points.withColumn(payload, F.when(chosen, _merged_json(F.col(payload), values)).otherwise(F.col(payload)))


def _json_map(text: Column) -> Column:
    """A JSON object as a map from key to the JSON text of its value."""
    v = F.try_parse_json(F.coalesce(text, F.lit("{}")))
    return F.transform_values(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)")), lambda k, x: F.to_json(x))


def _json_text(entries: Column) -> Column:
    quoted = F.transform(F.map_entries(entries), lambda e: F.concat(F.to_json(F.to_variant_object(F.array(e["key"]))), F.lit(":"), F.coalesce(e["value"], F.lit("null"))))
    # to_json of a one-element array quotes the key; its brackets go.
    keys = F.transform(quoted, lambda q: F.regexp_replace(q, r"^\[(.*?)\]:", "$1:"))
    return F.concat(F.lit("{"), F.array_join(keys, ","), F.lit("}"))


def _merged_json(text: Column, values: dict) -> Column:
    import json

    new = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, json.dumps(v, ensure_ascii=False))])
    kept = F.map_filter(_json_map(text), lambda k, x: ~k.isin(list(values)))
    return _json_text(F.map_concat(kept, new))


def overwrite_payload(points: DataFrame, values: dict, ids: list | None = None, flt: dict | None = None, get=None, id_col: str = "id", payload: list[str] | str = "payload") -> DataFrame:
    """The payload becomes values: other payload columns (or keys of a JSON-text column) go."""
    import json

    chosen = _chosen(points, ids, flt, get, id_col)
    if isinstance(payload, str):
        return _edit(points, {payload: F.lit(json.dumps(values, ensure_ascii=False))}, chosen)
    return _edit(points, {c: F.lit(values.get(c)) for c in payload}, chosen)


def delete_payload_keys(points: DataFrame, keys: list[str], ids: list | None = None, flt: dict | None = None, get=None, id_col: str = "id", payload: str | None = None) -> DataFrame:
    """The keys' values go: columns become null, keys leave a JSON-text column."""
    chosen = _chosen(points, ids, flt, get, id_col)
    if payload is None:
        return _edit(points, {k: F.lit(None) for k in keys if k in points.columns}, chosen)
    return _edit(points, {payload: _json_text(F.map_filter(_json_map(F.col(payload)), lambda k, x: ~k.isin(list(keys))))}, chosen)


def clear_payload(points: DataFrame, payload: list[str] | str = "payload", ids: list | None = None, flt: dict | None = None, get=None, id_col: str = "id") -> DataFrame:
    columns = [payload] if isinstance(payload, str) else payload
    return _edit(points, {c: F.lit(None) for c in columns}, _chosen(points, ids, flt, get, id_col))


def update_vectors(points: DataFrame, updates: DataFrame, column: str = "vector", id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """New vectors for the ids in updates (id, vector); versions stay. Of several for one id the last by order_col
    counts; without one, the largest vector, so that the result does not depend on partitions."""
    new = F.col(column).cast(points.schema[column].dataType)
    order = F.col(order_col) if order_col else new
    new = updates.groupBy(id_col).agg(F.max_by(new, order).alias("__new"))
    return points.join(new, id_col, "left").withColumn(column, F.coalesce("__new", column)).select(*points.columns)


def delete_vectors(points: DataFrame, names: list[str], ids: list | None = None, flt: dict | None = None, get=None, id_col: str = "id") -> DataFrame:
    """Drops the multivector (names "multivector" or ""), or named sparse vectors, of the chosen points."""
    chosen = _chosen(points, ids, flt, get, id_col)
    out = points
    if {"multivector", ""} & set(names):
        out = _edit(out, {"multivector": F.lit(None)}, chosen)
    named = [n for n in names if n not in ("multivector", "")]
    return _edit(out, {"sparse": F.map_filter("sparse", lambda k, v: ~k.isin(named))}, chosen) if named and "sparse" in out.columns else out


def batch_update(points: DataFrame, operations: list[dict], get=None, id_col: str = "id", payload=None) -> tuple[DataFrame, list[str]]:
    """Ordered operations {upsert | delete | set_payload | overwrite_payload | delete_payload | clear_payload: {...}}.

    Returns the points and each operation's status. The plan is cut every ten operations.
    """
    from pointsmith.session import cut

    status = []
    for n, op in enumerate(operations, 1):
        (name, arg), where = next(iter(op.items())), {}
        where = {"ids": arg.get("points") or arg.get("ids"), "flt": arg.get("filter"), "get": get, "id_col": id_col} if isinstance(arg, dict) else {}
        if name == "upsert":
            points = upsert(points, arg["points"] if isinstance(arg, dict) else arg, id_col)
        elif name == "delete":
            points = delete_by_filter(points, arg["filter"], get, id_col) if arg.get("filter") else delete_by_ids(points, arg.get("points") or arg.get("ids") or [], id_col)
        elif name == "set_payload":
            points = set_payload(points, arg["payload"], **where, payload=payload)
        elif name == "overwrite_payload":
            points = overwrite_payload(points, arg["payload"], **where, payload=payload or "payload")
        elif name == "delete_payload":
            points = delete_payload_keys(points, arg["keys"], **where, payload=payload if isinstance(payload, str) else None)
        elif name == "clear_payload":
            points = clear_payload(points, payload or "payload", **where)
        else:
            status.append("unknown operation")
            continue
        status.append("completed")
        if n % 10 == 0:
            points = cut(points.sparkSession, points)
    return points, status


def affected(points: DataFrame, ids: list | None = None, flt: dict | None = None, get=None, id_col: str = "id") -> DataFrame:
    """One row, `affected`: how many points an edit with this selection applies to."""
    return points.where(_chosen(points, ids, flt, get, id_col)).agg(F.count(F.lit(1)).alias("affected"))


def numbered(df: DataFrame, order: list, name: str = "__ord") -> DataFrame:
    """df with a batch position by `order`; for small batches, as one task numbers them."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
