"""Full-text search: postings and BM25 as joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from pointsmith.functions.textfn import tokenize
from pointsmith.session import cut

from .filters import Columns, certain, compile_filter

K1, B = 1.5, 0.75


def postings(docs: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(term, id, tf, doc_len). A document's terms are counted within its own partition: its id is unique."""
    tokens = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("tokens"))
    terms = tokens.select("id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    return terms.groupBy("term", "id", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(n, total): number of documents and of tokens."""
    return docs.select(F.size(tokenize(F.col(text_col))).alias("len")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))


def bm25(docs: DataFrame, query: str, limit: int = 10, text_col: str = "text", id_col: str = "id", k1: float = K1, b: float = B, flt: dict | None = None, get=None) -> DataFrame:
    """(id, score) of the best documents that hold a query term; repeated terms count each time.

    The texts are read and split once: each document's length and its frequencies of the query's terms, a few numbers,
    are written to the shared folder; statistics and scores are made from those. A filter chooses among the hits;
    statistics are those of all documents.
    """
    spark = docs.sparkSession
    # The query's terms by the same expressions as the texts'; a constant relation, folded without a job.
    own = spark.createDataFrame([(query,)], "q string").select(tokenize(F.col("q")).alias("t")).first()["t"] or []
    times = {t: own.count(t) for t in dict.fromkeys(own)}
    if not times:
        return docs.where("false").select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"))
    keep = certain(compile_filter(flt, get or Columns(docs.schema), id_col)) if flt else F.lit(True)
    tf = lambda tokens, term: F.size(F.filter(tokens, lambda x: x == F.lit(term)))
    found = F.transform(F.array(F.col("tokens")), lambda t: F.array(*[tf(t, w) for w in times]))
    split = docs.select(F.col(id_col).alias("id"), keep.alias("keep"), F.coalesce(tokenize(F.col(text_col)), F.expr("cast(array() as array<string>)")).alias("tokens"))
    slim = cut(spark, split.select("id", "keep", F.size("tokens").alias("len"), F.get(found, F.lit(0)).alias("tf")))
    at = lambda i: F.get("tf", F.lit(i))
    stats = slim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"), *[F.count(F.when(at(i) > 0, 1)).alias(f"df{i}") for i in range(len(times))])
    idf = lambda i: F.greatest(F.lit(0.0), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))
    part = lambda i, k: F.when(at(i) > 0, F.lit(k) * idf(i) * at(i) * (k1 + 1) / (at(i) + k1 * (1 - b + b * F.col("len") * F.col("n") / F.col("total")))).otherwise(0.0)
    hits = slim.where(F.col("keep") & F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    score = reduce(Column.__add__, [part(i, k) for i, k in enumerate(times.values())])
    return hits.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def replace_postings(index: DataFrame, docs: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """The index with these documents in place of what it had of their ids."""
    new = postings(docs, text_col, id_col)
    return delete_postings(index, docs.select(F.col(id_col).alias("id"))).unionByName(new.select(*index.columns))


def delete_postings(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without these ids (a frame with the column id)."""
    return index.join(ids.select("id").distinct(), "id", "left_anti").select(*index.columns)


def postings_stats(index: DataFrame, documents: int | None = None) -> DataFrame:
    """(n, total) of an index: documents that hold a term, and their tokens. documents: their number where some are empty."""
    own = index.select("id", "doc_len").distinct().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total"))
    return own if documents is None else own.withColumn("n", F.lit(documents).cast("bigint"))


def write_postings(index: DataFrame, path: str, buckets: int = 64) -> None:
    """The index in folders by a hash of the term, sorted within files: a query reads its terms' folders only."""
    dealt = index.withColumn("bucket", term_bucket(F.col("term"), buckets))
    # Salted by document, so a term that most documents hold is no single task's.
    dealt.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def term_bucket(term: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def read_postings(spark, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """What a stored index has of these terms; the folders and the files' row groups of others are not read."""
    wanted = spark.createDataFrame([(t,) for t in terms], "t string").select(term_bucket(F.col("t"), buckets).alias("b"))
    numbers = sorted({r["b"] for r in wanted.collect()})
    return spark.read.parquet(path).where(F.col("bucket").isin(numbers) & F.col("term").isin(list(terms))).drop("bucket")


def bm25_postings(index: DataFrame, stats: DataFrame, query: str, limit: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """The same over a stored index (postings) and its corpus statistics; the few query terms are broadcast."""
    terms = index.sparkSession.range(1).select(F.explode(tokenize(F.lit(query))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    counted = index.join(F.broadcast(terms), "term", "left_semi").select("id", F.col("doc_len").alias("len"), "term", "tf")
    return _scored(counted, terms, stats, limit, k1, b)


def _scored(counted: DataFrame, terms: DataFrame, stats: DataFrame, limit: int, k1: float, b: float) -> DataFrame:
    frequency = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = terms.join(frequency, "term").crossJoin(stats).select("term", "times", (F.col("total") / F.col("n")).alias("avg"), F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    # At most one row for each query term.
    parts = counted.join(F.broadcast(weights), "term").select("id", (F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))).alias("part"))
    return parts.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(limit)
