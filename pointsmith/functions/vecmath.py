"""Vector functions as Column expressions, accumulated in double whatever the element type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Norms up to this count as zero when vectors are normalised (the spacing of 32-bit floats at 1).
EPSILON = 1.1920928955078125e-07


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal_vector(values: list[float]) -> Column:
    """A constant vector, folded once by the optimizer."""
    return F.lit([float(x) for x in values])


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for different lengths."""
    product = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite for different lengths."""

    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(a, b, square)))).otherwise(F.lit(float("inf")))


def norm_squared(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(norm_squared(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths or a zero vector."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def normalize(v: Column) -> Column:
    """v at length one; unchanged if its norm is next to nothing. The norm is computed once."""
    own = doubles(v)
    scaled = F.transform(F.array(norm(own)), lambda n: F.transform(own, lambda x: F.when(n > EPSILON, x / n).otherwise(x)))
    return F.get(scaled, F.lit(0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def scale(v: Column, k: float) -> Column:
    return F.transform(doubles(v), lambda x: x * F.lit(float(k)))


def dim(v: Column) -> Column:
    return F.size(v)


def first(mv: Column) -> Column:
    """The first row of a multivector, null if there is none."""
    return F.get(mv, F.lit(0))


def is_multivector(mv: Column) -> Column:
    """Whether mv has rows, all of one length above zero."""
    width = F.size(F.get(mv, F.lit(0)))
    return F.coalesce((F.size(mv) > 0) & (width > 0) & F.forall(mv, lambda r: F.size(r) == width), F.lit(False))


def as_multivector(mv: Column, v: Column) -> Column:
    """mv, or the dense vector as its only row."""
    return F.coalesce(mv, F.when(v.isNotNull(), F.array(v)))


def _best_sum(query: Column, doc: Column, pick) -> Column:
    return F.aggregate(F.transform(query, pick), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def _same_width(query: Column, doc: Column) -> Column:
    return F.size(F.get(query, F.lit(0))) == F.size(F.get(doc, F.lit(0)))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: for each query row its largest inner product with a document row, summed; 0 for other widths."""
    best = _best_sum(query, doc, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.when(_same_width(query, doc), best).otherwise(0.0)


def max_sim_cosine(query: Column, doc: Column) -> Column:
    """Late interaction by cosine; rows of next to no length are passed over."""
    long = lambda rows: F.filter(rows, lambda r: norm(r) >= EPSILON)
    own = long(doc)
    best = _best_sum(long(query), own, lambda q: F.array_max(F.transform(own, lambda d: cosine(q, d))))
    return F.when(_same_width(query, doc), best).otherwise(0.0)


def max_sim_l2(query: Column, doc: Column) -> Column:
    """Late interaction by distance: minus each query row's least distance, summed; minus infinity for other widths."""
    best = _best_sum(query, doc, lambda q: -F.array_min(F.transform(doc, lambda d: l2_distance(q, d))))
    return F.when(_same_width(query, doc), best).otherwise(F.lit(float("-inf")))


def sparse_dot(doc: Column, query: dict[int, float] | list[tuple[int, float]]) -> Column:
    """Inner product of a sparse column {indices, values} with a query; repeated query indices add up, surplus entries don't count."""
    pairs = query.items() if isinstance(query, dict) else query
    total: dict[int, float] = {}
    for i, v in pairs:
        total[int(i)] = total.get(int(i), 0.0) + float(v)
    if not total:
        return F.lit(0.0)
    weights = F.create_map(*[F.lit(x) for i, v in sorted(total.items()) for x in (i, v)]).cast("map<bigint,double>")
    pairs = F.zip_with(doc["indices"], doc["values"], lambda i, v: F.struct(i.cast("bigint").alias("i"), v.cast("double").alias("v")))
    wanted = F.filter(pairs, lambda p: p["i"].isin(list(total)) & p["v"].isNotNull())

    def last(hits: Column) -> Column:
        """Of repeated indices the last counts."""
        kept = F.filter(hits, lambda p, at: ~F.exists(F.slice(hits, at + 2, F.size(hits)), lambda q: q["i"] == p["i"]))
        return F.transform(kept, lambda p: p["v"] * F.element_at(weights, p["i"]))

    # A lambda's variable holds the few hits, so they are found once.
    return _sum(F.get(F.transform(F.array(wanted), last), F.lit(0)))


def vector_mean(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """Element-wise average: one vector, or one for each group; sums leave the map side, not vectors."""
    keys = by or []
    parts = df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("mean"))
