"""Retrieval: score, filter, top-k. Every operator is lazy and orders by score descending, then id ascending.

Filters and pruning reach the scan; a top-k is TakeOrderedAndProject; top-k per query or group keeps k rows a task
before anything is shuffled (WindowGroupLimit). Query vectors are literals, or one-row frames that are broadcast.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.window import Window

from pointsmith.functions import kernels
from pointsmith.functions import vecmath as vm
from pointsmith.session import ship

from .filters import Columns, compile_filter
from .points import score_column

#: Query vectors in one batch that are broadcast; a larger batch is taken in blocks.
BATCH_QUERIES = 1000


def filtered(points: DataFrame, flt: dict | None, get=None, id_col: str = "id") -> DataFrame:
    return points.where(compile_filter(flt, get or Columns(points.schema), id_col)) if flt else points


def top_k(scored: DataFrame, limit: int, offset: int = 0, threshold: float | None = None, id_col: str = "id") -> DataFrame:
    """The page after offset. The threshold goes below the limit: scores descend, so what qualifies is a prefix."""
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    best = scored.orderBy(F.desc("score"), F.asc(id_col)).limit(limit + offset)
    return best.offset(offset) if offset else best


def knn(points: DataFrame, query: list[float], limit: int = 10, distance: str = "Cosine", flt: dict | None = None, offset: int = 0, threshold: float | None = None, scoring: str = "true", vector: str = "vector", id_col: str = "id", get=None) -> DataFrame:
    """Exact nearest neighbours of a vector, pre-filtered."""
    kept = filtered(points, flt, get, id_col).where(F.col(vector).isNotNull())
    return top_k(kept.withColumn("score", score_column(F.col(vector), query, distance, scoring)), limit, offset, threshold, id_col)


def _by_query(points: DataFrame, one: DataFrame, distance: str, vector: str, scoring: str = "true") -> DataFrame:
    """points scored against the vector `q` of a one-row frame."""
    both = points.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(one.select("q")))
    return both.withColumn("score", score_column(F.col(vector), F.col("q"), distance, scoring)).drop("q")


def knn_by_id(points: DataFrame, source_id: object, limit: int = 10, distance: str = "Cosine", flt: dict | None = None, vector: str = "vector", id_col: str = "id", get=None) -> DataFrame:
    """Neighbours of a stored point, itself left out. An unknown id has no vector, so no neighbours."""
    one = points.where(F.col(id_col) == F.lit(source_id)).select(F.col(vector).alias("q")).limit(1)
    others = filtered(points, flt, get, id_col).where(F.col(id_col) != F.lit(source_id))
    return top_k(_by_query(others, one, distance, vector), limit, id_col=id_col)


def knn_batch(points: DataFrame, queries: DataFrame, limit: int = 10, distance: str = "Cosine", flt: dict | None = None, vector: str = "vector", id_col: str = "id", get=None) -> DataFrame:
    """(query_id, id, score, rank) for a frame of queries (query_id, q).

    Blocks of at most BATCH_QUERIES queries, dealt by a hash of their ids, are broadcast as a matrix; each block of
    points is scored by one matrix product, and only entries from its k-th best on leave Python. Every task then keeps
    its own k best of each query before the shuffle, so what moves is k rows a query and task.
    """
    kept = filtered(points, flt, get, id_col).where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    asked = queries.select("query_id", "q").where("q is not null")
    n = asked.count()
    blocks = 1 if n <= BATCH_QUERIES else -(-n // (BATCH_QUERIES // 2))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {kept.schema['id'].dataType.simpleString()}, score double"
    parts = []
    for b in range(blocks):
        own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        for width in sorted({len(v) for v in own.column("q").to_pylist()}):
            parts.append(_scored_block(kept, own, width, limit, distance, schema))
    if not parts:
        return kept.sparkSession.createDataFrame([], schema + ", rank int")
    found = [x.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit) for x in parts]
    return reduce(DataFrame.unionByName, found)


def _scored_block(kept: DataFrame, queries: pa.Table, width: int, limit: int, distance: str, schema: str) -> DataFrame:
    """The queries of one width against all points: (query_id, id, score) of each block's best."""
    column = queries.column("q").combine_chunks()
    q, fits = kernels.matrix(column, width)
    names = queries.column("query_id").combine_chunks().filter(pa.array(fits))
    ship(kept.sparkSession)
    shared = kept.sparkSession.sparkContext.broadcast((names, q[fits]))

    def run(batches):
        names, q = shared.value
        for batch in batches:
            x, ok = kernels.matrix(batch.column(1), width)
            scores = kernels.score_block(x, ok, q, distance)
            row, col = kernels.best(scores, limit)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(col)), batch.column(0).take(pa.array(row)), pa.array(scores[row, col])], ["query_id", "id", "score"])

    return kept.mapInArrow(run, schema)


def recommend(points: DataFrame, positive: list, negative: list | None = None, limit: int = 10, distance: str = "Cosine", flt: dict | None = None, threshold: float | None = None, vector: str = "vector", id_col: str = "id", get=None) -> DataFrame:
    """Neighbours of the positives' mean, or of twice it less the negatives' mean; no example is returned.

    Unknown ids are ignored; without a known positive there is no query and no result.
    """
    negative = negative or []
    own = points.where(F.col(id_col).isin(positive + negative)).select(F.explode(F.filter(F.array(F.when(F.col(id_col).isin(positive), 1), F.when(F.col(id_col).isin(negative), -1)), lambda x: x.isNotNull())).alias("sign"), vector)
    parts = own.select("sign", F.posexplode(vm.doubles(F.col(vector))).alias("pos", "x")).groupBy("pos").agg(F.avg(F.when(F.col("sign") == 1, F.col("x"))).alias("p"), F.avg(F.when(F.col("sign") == -1, F.col("x"))).alias("n"))
    mixed = parts.where("p is not null").select("pos", F.when(F.col("n").isNull(), F.col("p")).otherwise(2 * F.col("p") - F.col("n")).alias("x"))
    one = mixed.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("q")).where(F.size("q") > 0)
    others = filtered(points, flt, get, id_col).where(~F.col(id_col).isin(positive + negative))
    return top_k(_by_query(others, one, distance, vector), limit, threshold=threshold, id_col=id_col)


def discover(points: DataFrame, target: object, context: list[tuple] | None = None, limit: int = 10, distance: str = "Cosine", flt: dict | None = None, vector: str = "vector", id_col: str = "id", get=None) -> DataFrame:
    """Neighbours of a target (a vector, or a point's id; that point stays in). context: pairs of ids (positive,
    negative); points nearer to more positives than negatives come first. Without context, plain neighbours."""
    kept = filtered(points, flt, get, id_col)
    if isinstance(target, list):
        scored = kept.where(F.col(vector).isNotNull()).withColumn("score", score_column(F.col(vector), target, distance))
    else:
        scored = _by_query(kept, points.where(F.col(id_col) == F.lit(target)).select(F.col(vector).alias("q")).limit(1), distance, vector)
    if not context:
        return top_k(scored, limit, id_col=id_col)
    ids = [i for pair in context for i in pair]
    known = points.where(F.col(id_col).isin(ids)).agg(F.map_from_entries(F.collect_list(F.struct(F.col(id_col).cast("string"), F.col(vector)))).alias("examples"))
    both = scored.crossJoin(F.broadcast(known))
    near = lambda i: score_column(F.col(vector), F.try_element_at(F.col("examples"), F.lit(str(i))), distance)
    wins = reduce(Column.__add__, [F.coalesce((near(p) > near(n)).cast("int"), F.lit(0)) for p, n in context])
    return both.withColumn("wins", wins).drop("examples").orderBy(F.desc("wins"), F.desc("score"), id_col).limit(limit)


def sparse_search(points: DataFrame, query: dict[int, float] | list[tuple[int, float]], limit: int = 10, using: str = "default", flt: dict | None = None, sparse: str = "sparse", id_col: str = "id", get=None) -> DataFrame:
    """Inner product with a named sparse vector; only positive scores."""
    kept = filtered(points, flt, get, id_col).withColumn("__own", F.try_element_at(F.col(sparse), F.lit(using))).where("__own is not null")
    return top_k(kept.withColumn("score", vm.sparse_dot(F.col("__own"), query)).drop("__own").where("score > 0"), limit, id_col=id_col)


def sparse_search_postings(postings: DataFrame, query: DataFrame, limit: int = 10, id_col: str = "id") -> DataFrame:
    """The same over an inverted index (id, index, value) and a query frame (index, value): a broadcast join and a sum."""
    joined = postings.join(F.broadcast(query.groupBy("index").agg(F.sum("value").alias("w"))), "index")
    return top_k(joined.groupBy(id_col).agg(F.sum(F.col("value").cast("double") * F.col("w")).alias("score")).where("score > 0"), limit, id_col=id_col)


def multivector_search(points: DataFrame, query: list[list[float]], limit: int = 10, distance: str = "Dot", flt: dict | None = None, multivector: str = "multivector", vector: str | None = "vector", id_col: str = "id", get=None) -> DataFrame:
    """Late interaction; points with a dense vector only count as multivectors of one row."""
    kept = filtered(points, flt, get, id_col)
    own = vm.as_multivector(F.col(multivector), F.col(vector)) if vector else F.col(multivector)
    kept = kept.where(own.isNotNull())
    q = F.lit([[float(x) for x in r] for r in query])
    measure = {"Dot": vm.max_sim, "Cosine": vm.max_sim_cosine, "Euclidean": vm.max_sim_l2}[distance]
    return top_k(kept.withColumn("score", measure(q, own)), limit, id_col=id_col)


def search_groups(points: DataFrame, query: list[float], group_by: str, limit: int = 5, group_size: int = 3, distance: str = "Cosine", flt: dict | None = None, vector: str = "vector", id_col: str = "id", get=None) -> DataFrame:
    """The best group_size hits of the best `limit` groups, out of the best limit * group_size * 2 hits.

    Groups are ordered by their best score, then key; hits without the key are in the group `unknown`.
    """
    pool = knn(points, query, limit * group_size * 2, distance, flt, vector=vector, id_col=id_col, get=get)
    return _grouped(pool, group_by, limit, group_size, id_col)


def query_groups(points: DataFrame, request: dict, group_by: str, limit: int = 5, group_size: int = 3, distance: str = "Cosine", get=None, id_col: str = "id") -> DataFrame:
    """search_groups for any form of the universal query."""
    pool = query(points, request | {"limit": limit * group_size * 2, "offset": 0}, distance, get)
    return _grouped(pool, group_by, limit, group_size, id_col)


def _grouped(pool: DataFrame, group_by: str, limit: int, group_size: int, id_col: str) -> DataFrame:
    keyed = pool.withColumn("group", F.coalesce(F.col(group_by).cast("string"), F.lit("unknown")))
    within = Window.partitionBy("group").orderBy(F.desc("score"), id_col)
    placed = keyed.withColumn("rank", F.row_number().over(within)).withColumn("best", F.max("score").over(Window.partitionBy("group")))
    # The pool is at most limit * group_size * 2 rows, so one task can number its groups.
    ranked = placed.withColumn("group_rank", F.dense_rank().over(Window.orderBy(F.desc("best"), "group")))
    return ranked.where((F.col("rank") <= group_size) & (F.col("group_rank") <= limit))


def _batch(results: list[DataFrame]) -> DataFrame:
    """(query_no, id, score) of several results, one plan."""
    return reduce(DataFrame.unionByName, [r.select(F.lit(i).alias("query_no"), "id", "score") for i, r in enumerate(results)])


def query_batch(points: DataFrame, requests: list[dict], distance: str = "Cosine", get=None) -> DataFrame:
    """(query_no, id, score): universal queries of any forms, each with its own limit. For many vectors use knn_batch."""
    return _batch([query(points, r, distance, get) for r in requests])


def discover_batch(points: DataFrame, requests: list[dict], distance: str = "Cosine", get=None) -> DataFrame:
    """(query_no, id, score): requests {target, context, limit, filter}."""
    return _batch([discover(points, r["target"], r.get("context"), r.get("limit", 10), distance, r.get("filter"), get=get) for r in requests])


def query(points: DataFrame, request: dict, distance: str = "Cosine", get=None) -> DataFrame:
    """The universal query: {query, prefetch, using, filter, limit, offset, score_threshold}.

    query is a vector, a multivector, a sparse {indices, values}, an id, {text} (or the request has text), or
    {fusion: rrf} over prefetch legs. offset and score_threshold hold for every form.
    """
    from . import text_search
    from .fusion import rrf

    q, limit, flt = request.get("query", request.get("vector")), request.get("limit", 10), request.get("filter")
    if isinstance(q, dict) and "fusion" in q:
        if not request.get("prefetch"):
            raise ValueError("fusion needs prefetch")
        legs = [query(points, leg | {"limit": leg.get("limit", 20)}, distance, get).select("id", "score") for leg in request["prefetch"]]
        return rrf(legs, limit).join(points, "id").orderBy(F.desc("score"), "id")
    offset, threshold = request.get("offset") or 0, request.get("score_threshold")
    if isinstance(q, list) and q and not isinstance(q[0], list):
        return knn(points, q, limit, distance, flt, offset, threshold, get=get)
    if isinstance(q, dict) and "text" in q or q is None and request.get("text"):
        text = q["text"] if q else request["text"]
        found = text_search.bm25(points, text, limit + offset, flt=flt, get=get, text_col=request.get("using", "text")).join(points, "id")
    elif isinstance(q, dict) and {"indices", "values"} <= q.keys():
        found = sparse_search(points, list(zip(q["indices"], q["values"])), limit + offset, request.get("using", "default"), flt, get=get)
    elif isinstance(q, list) and q:
        found = multivector_search(points, q, limit + offset, distance, flt, get=get)
    elif isinstance(q, (int, str)):
        found = knn_by_id(points, str(q) if points.schema["id"].dataType.typeName() == "string" else q, limit + offset, distance, flt, get=get)
    else:
        raise ValueError("query must be a vector, multivector, sparse vector, text, id or fusion")
    return top_k(found, limit, offset, threshold)


def project(hits: DataFrame, with_payload: bool | list[str] | dict = True, with_vector: bool = False, payload: str = "payload", missing: str = "null") -> DataFrame:
    """Result columns. with_payload: all, none, a list of fields, or {include} / {exclude}.

    missing: how a missing payload shows, `null` (search, get) or `empty` (scroll: {} for JSON text, a struct of nulls).
    """
    if missing == "empty" and payload in hits.columns:
        kind = hits.schema[payload].dataType
        blank = F.lit("{}") if kind.typeName() == "string" else F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
        hits = hits.withColumn(payload, F.coalesce(payload, blank))
    vectors = [c for c in ("vector", "multivector", "sparse") if c in hits.columns]
    out = hits if with_vector else hits.drop(*vectors)
    if payload not in out.columns or with_payload is True:
        return out
    if not with_payload:
        return out.drop(payload)
    fields = out.schema[payload].dataType.fieldNames()
    if isinstance(with_payload, dict):
        chosen = with_payload["include"] if "include" in with_payload else [f for f in fields if f not in with_payload.get("exclude", [])]
    else:
        chosen = with_payload
    return out.withColumn(payload, F.struct(*[F.col(payload)[f].alias(f) for f in chosen if f in fields]))
