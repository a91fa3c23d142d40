"""Approximate neighbours: an inverted file. Centres are fitted on a bounded sample; every row is indexed.

The index is the points with their nearest centre's number as a partition column of the table, so a search for n
probes reads n cells' files only and re-ranks them exactly. Cells are balanced by taking about sqrt(rows) centres, but
at most `MAX_CELLS`, so that the centres stay a small broadcast; sampled rows are held against them in blocks.

The second index here is for vectors that hardly cluster: binary codes of random hyperplanes beside each vector. A
search looks at every row's code, an eighth of a 64-wide vector's bytes, and reads the vectors of the nearest only.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from pointsmith.functions import kernels
from pointsmith.session import ship

from .points import score_column
from .search import BATCH_QUERIES, filtered, knn_batch, top_k

#: Rows that centres are fitted on, at most.
SAMPLE_ROWS = 50_000
#: Share of the cells that a search probes by default: vectors without much of a cluster structure need so many for a
#: recall of 0.9, and the share needed falls as tables grow.
PROBE_SHARE = 0.65
MAX_CELLS = 16_384
#: Rows held against all centres, or a thousand queries, at a time.
FIT_BLOCK = 2048
#: Queries, with a byte for each cell, that are broadcast at a time.
QUERY_BYTES = 32 << 20
#: Rows of an index that one task of a batch search reads, from so many rows on that each core has as many.
TASK_ROWS = 1 << 20
#: Scored pairs that a task gathers before it keeps the best of each query only.
PENDING = 500_000


def fit_centres(points: DataFrame, cells: int, vector: str = "vector", id_col: str = "id", sample_rows: int = SAMPLE_ROWS, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means on a bounded sample, chosen by a hash of the id."""
    kept = points.where(F.col(vector).isNotNull())
    got = kept.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).select(vector).toArrow().column(0)
    x = np.array(got.to_pylist(), np.float32)
    if not len(x):
        raise ValueError("no vectors to fit on")
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + FIT_BLOCK] @ centres.T).argmax(axis=1) for i in range(0, len(x), FIT_BLOCK)])
        for c in range(len(centres)):
            if (members := x[own == c]).size:
                m = members.sum(axis=0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
    return centres


def assign(points: DataFrame, centres: np.ndarray, vector: str = "vector") -> DataFrame:
    """points with `cell`, the nearest centre of every row (rows without a vector: -1). centres are broadcast: cells x width floats."""
    ship(points.sparkSession)
    shared = points.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell(v):
        out = np.full(len(v), -1, np.int32)
        ok = v.notna().to_numpy()
        if ok.any():
            x = np.stack(v[ok].to_numpy()).astype(np.float32)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            out[ok] = np.concatenate([(x[i : i + FIT_BLOCK] @ shared.value.T).argmax(axis=1) for i in range(0, len(x), FIT_BLOCK)])
        import pandas as pd

        return pd.Series(out)

    return points.withColumn("cell", cell(F.col(vector)))


def build(points: DataFrame, path: str, cells: int | None = None, vector: str = "vector", id_col: str = "id", **fit) -> np.ndarray:
    """Write the index: one folder a cell. Returns the centres, also stored beside it."""
    n = cells or min(MAX_CELLS, max(1, int(points.count() ** 0.5)))
    centres = fit_centres(points, n, vector, id_col, **fit)
    spark = points.sparkSession
    assign(points, centres, vector).repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return centres


def load_centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows], np.float32)


def default_probes(centres: np.ndarray) -> int:
    return max(8, math.ceil(PROBE_SHARE * len(centres)))


def probe(centres: np.ndarray, query: list[float], probes: int) -> list[int]:
    q = np.asarray(query, np.float32)
    near = centres @ (q / max(np.linalg.norm(q), 1e-12))
    return np.argsort(-near, kind="stable")[:probes].tolist()


def search(index: DataFrame, centres: np.ndarray, query: list[float], limit: int = 10, probes: int | None = None, distance: str = "Cosine", flt: dict | None = None, vector: str = "vector", id_col: str = "id", get=None) -> DataFrame:
    """Exact ranking of the probed cells' rows; the filter comes before the top-k."""
    kept = filtered(index.where(F.col("cell").isin(probe(centres, query, probes or default_probes(centres)))), flt, get, id_col)
    return top_k(kept.withColumn("score", score_column(F.col(vector), query, distance)), limit, id_col=id_col).drop("cell")


def search_batch(index: DataFrame, centres: np.ndarray, queries: DataFrame, limit: int = 10, probes: int | None = None, distance: str = "Cosine", flt: dict | None = None, vector: str = "vector", id_col: str = "id", get=None) -> DataFrame:
    """(query_id, id, score, rank) for a frame of queries (query_id, q), each over its own cells.

    The queries are broadcast with the cells that they probe, `QUERY_BYTES` at a time. A task scores the rows of a cell
    by one matrix product with the queries that probe it, and gives its own best of each query when it has read all its
    rows; a few large tasks read the index, so that few rows a query are shuffled.
    """
    ship(index.sparkSession)
    shared = index.sparkSession.sparkContext.broadcast(centres)
    n_probes = probes or default_probes(centres)

    @F.pandas_udf("binary")
    def cells(q):
        import pandas as pd

        def bits(x):
            own = np.zeros(len(shared.value), bool)
            own[probe(shared.value, x, n_probes)] = True
            return np.packbits(own).tobytes()

        return pd.Series([bits(x) for x in q])

    kept = filtered(index.where(F.col(vector).isNotNull()), flt, get, id_col).select(F.col(id_col).alias("id"), F.col(vector).alias("v"), "cell")
    asked = queries.where("q is not null").select("query_id", "q", cells("q").alias("cells"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kept.schema['id'].dataType.simpleString()}, score double"
    n = queries.where("q is not null").count()
    most = max(1, QUERY_BYTES // (len(centres) + 8 * centres.shape[1]))
    parts = 1 if n <= most else -(-2 * n // most)
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-index.count() // TASK_ROWS))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def block(b: int) -> DataFrame:
        part = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b)
        scored = _scored_cells(kept.coalesce(tasks), part.toArrow(), centres.shape, max(1, limit), distance, schema)
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)

    return reduce(DataFrame.unionByName, [block(b) for b in range(parts)])


def _first(found: pa.Table, limit: int) -> tuple[pa.Table, np.ndarray]:
    """The best rows of each query, by score and then id, and their places."""
    found = found.sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
    query = found["query"].to_numpy()
    start = np.flatnonzero(np.diff(query, prepend=-1))
    place = np.arange(len(query)) - np.repeat(start, np.diff(start, append=len(query)))
    return found.filter(pa.array(place < limit)), place[place < limit]


def _scored_cells(kept: DataFrame, asked: pa.Table, shape: tuple[int, int], limit: int, distance: str, schema: str) -> DataFrame:
    """Rows (id, v, cell) against the queries that probe their cell: (query_id, id, score) of each task's best."""
    n_cells, width = shape
    q, fits = kernels.matrix(asked.column("q").combine_chunks(), width)
    if not fits.all():
        raise ValueError(f"queries need {width} numbers each")
    bits = np.frombuffer(b"".join(asked.column("cells").to_pylist()), np.uint8).reshape(len(q), -(-n_cells // 8))
    shared = kept.sparkSession.sparkContext.broadcast((asked.column("query_id").combine_chunks(), q, bits))

    def run(batches):
        names, q, bits = shared.value
        probed = np.unpackbits(bits, axis=1, count=n_cells).astype(bool)
        # The k-th best score of each query so far: what is less can't be among its best.
        floor = np.full(len(q), -np.inf)
        # How far a product may be from the pair's own score, in lengths.
        slack = np.zeros(len(q)) if distance == "Euclidean" else 1e-11 * (np.linalg.norm(q, axis=1) if distance == "Dot" else np.ones(len(q)))
        found, pending = [], 0

        def settle():
            nonlocal found, pending
            top, place = _first(pa.concat_tables(found), limit)
            last = place == limit - 1
            floor[top["query"].to_numpy()[last]] = top["score"].to_numpy()[last]
            found, pending = [top], 0

        for batch in batches:
            x, ok = kernels.matrix(batch.column(1), width)
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            longest = np.linalg.norm(x, axis=1).max(initial=0.0) if distance == "Dot" else 1.0
            for c in np.unique(cell):
                rows, own = np.flatnonzero(cell == c), np.flatnonzero(probed[:, c])
                for i in range(0, len(rows), FIT_BLOCK):
                    for j in range(0, len(own), BATCH_QUERIES):
                        r, o = rows[i : i + FIT_BLOCK], own[j : j + BATCH_QUERIES]
                        at, col = kernels.at_least(kernels.score_block(x[r], ok[r], q[o], distance), limit, floor[o], slack[o] * longest)
                        score = kernels.score_pairs(x[r], ok[r], q[o], at, col, distance)
                        found.append(pa.table({"query": o[col], "id": batch.column(0).take(pa.array(r[at])), "score": score}))
                        pending += len(at)
                        if pending > PENDING:
                            settle()
        if found:
            settle()
            top = found[0].combine_chunks()
            for out in top.select(["query", "id", "score"]).to_batches(max_chunksize=10_000):
                yield pa.RecordBatch.from_arrays([names.take(out.column(0)), out.column(1), out.column(2)], ["query_id", "id", "score"])

    return kept.mapInArrow(run, schema)


# -- binary codes: every row is looked at, by 256 bits; few rows' vectors are read
CODE_BITS = 256


def planes(width: int, bits: int = CODE_BITS, seed: int = 11) -> np.ndarray:
    """Random hyperplanes, the same for the same width: nothing is fitted."""
    return np.random.default_rng(seed).standard_normal((width, bits))


def codes_of(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words: on which side of each hyperplane a vector lies."""
    return np.packbits(x @ h > 0, axis=1).view(np.int64)


def with_codes(points: DataFrame, width: int, vector: str = "vector", bits: int = CODE_BITS) -> DataFrame:
    """points with `code`, bits / 64 longs, null for vectors of another length."""
    ship(points.sparkSession)

    @F.pandas_udf("array<bigint>")
    def code(v):
        import pandas as pd

        h, out = planes(width, bits), [None] * len(v)
        at = [i for i, x in enumerate(v) if x is not None and len(x) == width]
        if at:
            for i, words in zip(at, codes_of(np.stack([np.asarray(v.iloc[i], np.float64) for i in at]), h)):
                out[i] = words
        return pd.Series(out)

    return points.withColumn("code", code(F.col(vector)))


def candidates(rows: int, limit: int) -> int:
    """How many rows are ranked exactly: the share falls with the root of the table."""
    return max(10 * limit, math.ceil(4.4 * rows**0.5))


def search_codes(index: DataFrame, queries: DataFrame, limit: int = 10, distance: str = "Cosine", rerank: int | None = None, flt: dict | None = None, vector: str = "vector", id_col: str = "id", get=None) -> DataFrame:
    """(query_id, id, score, rank): the rows whose codes are nearest in bits, ranked exactly by their vectors.

    index: points with codes, as a stored table, so that the first pass reads codes and filtered columns only. Bits are
    counted in generated code; each task keeps `rerank` rows a query before the shuffle. For Cosine, and for the other
    distances over vectors of about one length.
    """
    width = index.where(F.col("code").isNotNull()).select(F.size(vector).alias("w")).first()
    if width is None:
        return knn_batch(index.where("false"), queries, limit, distance, vector=vector, id_col=id_col)
    asked = with_codes(queries.where("q is not null").select("query_id", "q"), width["w"], "q").where("code is not null")
    most = rerank or candidates(index.count(), limit)
    words = CODE_BITS // 64
    seen = filtered(index, flt, get, id_col).where("code is not null").select(F.col(id_col).alias("id"), *[F.col("code")[i].alias(f"c{i}") for i in range(words)])
    near = Window.partitionBy("query_id").orderBy("bits", "id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    n = asked.count()
    blocks = max(1, -(-n // BATCH_QUERIES))

    def block(b: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        short = part.select("query_id", *[F.col("code")[i].alias(f"q{i}") for i in range(words)])
        bits = reduce(Column.__add__, [F.bit_count(F.col(f"c{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(words)])
        chosen = seen.crossJoin(F.broadcast(short)).select("query_id", "id", bits.alias("bits")).withColumn("n", F.row_number().over(near)).where(F.col("n") <= most).select("query_id", "id")
        full = chosen.join(index.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), "id").join(F.broadcast(part.select("query_id", "q")), "query_id")
        scored = full.select("query_id", "id", score_column(F.col("v"), F.col("q"), distance).alias("score"))
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)

    return reduce(DataFrame.unionByName, [block(b) for b in range(blocks)])


#: From so many rows on an index is used where there is one.
EXACT_ROWS = 10_000


def search_any(points: DataFrame, queries: DataFrame, limit: int = 10, distance: str = "Cosine", flt: dict | None = None, vector: str = "vector", id_col: str = "id", get=None, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Exact search for small tables and for those without codes, else by codes."""
    if "code" in points.columns and points.count() >= exact_rows:
        return search_codes(points, queries, limit, distance, None, flt, vector, id_col, get)
    return knn_batch(points, queries, limit, distance, flt, vector, id_col, get)


def recall(exact: list, found: list) -> float:
    return len(set(exact) & set(found)) / max(1, len(set(exact)))


def remove(index: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    return index.where(~F.col(id_col).cast("string").isin([str(i) for i in ids]))
