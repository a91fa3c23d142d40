"""Queries over the test tables, one for each operator, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from pointsmith.functions import textfn, vecmath as vm
from pointsmith.operators import aggregate, filters, fusion, mutate, paging, search, text_search
from pointsmith.operators.points import as_points
from pointsmith.session import cut, scratch, scratch_name, table
from pointsmith.sources import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _vector_of(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """One query vector, needed to build a plan with a literal."""
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _hits(df: DataFrame, *more: str | Column) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), *more)


# DuckDB fragments
_V = "embedding::DOUBLE[]"
_Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_COS = f"list_cosine_similarity({_V}, {_Q0})"
_KNN = "SELECT vec_id AS id, round(s, 6) AS score FROM (SELECT vec_id, {score} AS s FROM embeddings WHERE {where}) ORDER BY s DESC, vec_id LIMIT {k}"


def _knn_sql(score: str = _COS, where: str = "true", k: int = 10) -> str:
    return _KNN.format(score=score, where=where, k=k)


# -- nearest neighbours
@query(_knn_sql())
def knn_cosine(spark, d):
    return _hits(search.knn(_vectors(spark, d), _vector_of(spark, d)))


@query(_knn_sql(f"0 - list_distance({_V}, {_Q0})"))
def knn_l2(spark, d):
    return _hits(search.knn(_vectors(spark, d), _vector_of(spark, d), distance="Euclidean"))


@query(_knn_sql(f"list_dot_product({_V}, {_Q0})"))
def knn_dot(spark, d):
    return _hits(search.knn(_vectors(spark, d), _vector_of(spark, d), distance="Dot"))


@query(_knn_sql(f"list_dot_product({_V}, {_Q0}) / sqrt(list_dot_product({_Q0}, {_Q0}))"))
def knn_query_normalized(spark, d):
    return _hits(search.knn(_vectors(spark, d), _vector_of(spark, d), scoring="query_normalized"))


@query(_knn_sql(where="label = 2"))
def knn_filtered_eq(spark, d):
    return _hits(search.knn(_vectors(spark, d), _vector_of(spark, d), flt={"must": [{"key": "label", "match": {"value": 2}}]}))


@query(_knn_sql(where="label IN (1, 3, 5)"))
def knn_filtered_any(spark, d):
    return _hits(search.knn(_vectors(spark, d), _vector_of(spark, d), flt={"must": [{"key": "label", "match": {"any": [1, 3, 5]}}]}))


@query(_knn_sql(where="label >= 2 AND label < 6"))
def knn_filtered_range(spark, d):
    return _hits(search.knn(_vectors(spark, d), _vector_of(spark, d), flt={"must": [{"key": "label", "range": {"gte": 2, "lt": 6}}]}))


@query(_knn_sql(where="label <> 2"))
def knn_filtered_must_not(spark, d):
    return _hits(search.knn(_vectors(spark, d), _vector_of(spark, d), flt={"must_not": [{"key": "label", "match": {"value": 2}}]}))


@query(_knn_sql(where="label = 1 OR label > 7"))
def knn_filtered_should(spark, d):
    return _hits(search.knn(_vectors(spark, d), _vector_of(spark, d), flt={"should": [{"key": "label", "match": {"value": 1}}, {"key": "label", "range": {"gt": 7}}]}))


@query(f"SELECT vec_id AS id, round(s, 6) AS score FROM (SELECT vec_id, {_COS} AS s FROM embeddings) WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 10 OFFSET 5")
def knn_threshold_offset(spark, d):
    return _hits(search.knn(_vectors(spark, d), _vector_of(spark, d), offset=5, threshold=0.2))


@query(_knn_sql(where="vec_id <> 0"))
def knn_by_id(spark, d):
    return _hits(search.knn_by_id(_vectors(spark, d), 0))


@query(
    f"""SELECT query_id, id, round(s, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, p.vec_id AS id, list_cosine_similarity(p.{_V}, q.{_V}) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(p.{_V}, q.{_V}) DESC, p.vec_id)::INT AS rank
  FROM embeddings p, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 10"""
)
def knn_batch(spark, d):
    points = _vectors(spark, d)
    asked = points.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    return search.knn_batch(points, asked).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH pool AS (SELECT vec_id, label, {_COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 24),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rn, max(s) OVER (PARTITION BY label) AS best FROM pool),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY best DESC, label::VARCHAR) AS gr FROM placed)
SELECT vec_id AS id, round(s, 6) AS score, label::VARCHAR AS "group", rn::INT AS rank, gr::INT AS group_rank FROM ranked WHERE rn <= 3 AND gr <= 4"""
)
def search_groups(spark, d):
    found = search.search_groups(_vectors(spark, d), _vector_of(spark, d), "label", limit=4, group_size=3)
    return _hits(found, "group", "rank", "group_rank")


_MEAN = "SELECT pos, avg(x) AS x FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE vec_id IN ({ids})) GROUP BY pos"


def _recommend_sql(positive: str, negative: str | None) -> str:
    p = _MEAN.format(ids=positive)
    mixed = f"SELECT p.pos, 2 * p.x - n.x AS x FROM ({p}) p JOIN ({_MEAN.format(ids=negative)}) n USING (pos)" if negative else p
    out = f"{positive}, {negative}" if negative else positive
    return f"WITH q AS (SELECT list(x ORDER BY pos) AS v FROM ({mixed})) SELECT vec_id AS id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity({_V}, q.v) AS s FROM embeddings, q WHERE vec_id NOT IN ({out})) ORDER BY s DESC, vec_id LIMIT 10"


@query(_recommend_sql("0, 1, 2", None))
def recommend_pos(spark, d):
    return _hits(search.recommend(_vectors(spark, d), [0, 1, 2]))


@query(_recommend_sql("0, 1", "5, 6"))
def recommend_pos_neg(spark, d):
    return _hits(search.recommend(_vectors(spark, d), [0, 1], [5, 6]))


@query(_knn_sql(where="label < 5"))
def discover_target(spark, d):
    return _hits(search.discover(_vectors(spark, d), 0, flt={"must": [{"key": "label", "range": {"lt": 5}}]}))


@query(
    f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings),
x AS (SELECT vec_id, list_cosine_similarity(v, {_Q0}) AS s,
  (list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 1)) > list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 2)))::INT
  + (list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 3)) > list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 4)))::INT AS wins FROM e)
SELECT vec_id AS id, round(s, 6) AS score, wins FROM x ORDER BY wins DESC, s DESC, vec_id LIMIT 10"""
)
def discover_context(spark, d):
    return _hits(search.discover(_vectors(spark, d), 0, context=[(1, 2), (3, 4)]), "wins")


def _multi(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").groupBy(F.expr("vec_id div 4").alias("id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("z"))
    return rows.select("id", F.transform("z", lambda x: x["embedding"]).alias("multivector"))


def _maxsim_sql(pair: str, best: str) -> str:
    return f"""WITH p AS (SELECT d.vec_id // 4 AS id, q.vec_id AS qi, {pair} AS s FROM embeddings d, (SELECT * FROM embeddings WHERE vec_id < 2) q)
SELECT id, round(sum(b), 6) AS score FROM (SELECT id, qi, {best}(s) AS b FROM p GROUP BY id, qi) GROUP BY id ORDER BY sum(b) DESC, id LIMIT 10"""


def _maxsim(spark, d, distance: str) -> DataFrame:
    return _hits(search.multivector_search(_multi(spark, d), [_vector_of(spark, d, 0), _vector_of(spark, d, 1)], 10, distance, vector=None))


@query(_maxsim_sql(f"list_dot_product(d.{_V}, q.{_V})", "max"))
def maxsim_dot(spark, d):
    return _maxsim(spark, d, "Dot")


@query(_maxsim_sql(f"list_cosine_similarity(d.{_V}, q.{_V})", "max"))
def maxsim_cosine(spark, d):
    return _maxsim(spark, d, "Cosine")


@query(_maxsim_sql(f"-list_distance(d.{_V}, q.{_V})", "max"))
def maxsim_l2(spark, d):
    return _maxsim(spark, d, "Euclidean")


# -- text
_TOKENS = r"""list_filter(list_transform(regexp_split_to_array(lower(text), '[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}!-/:-@\[-`{-~]+'), lambda x: regexp_replace(x, '^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$', '', 'g')), lambda x: strlen(x) > 1)"""


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").withColumn("id", F.col("doc_id"))


@query(f"SELECT doc_id AS id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_terms FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def tokenize_counts(spark, d):
    own = _documents(spark, d).select("id", textfn.tokenize(F.col("text")).alias("t"))
    return own.select("id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term HAVING count(DISTINCT doc_id) >= 20")
def postings_terms(spark, d):
    index = text_search.postings(_documents(spark, d))
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where("df >= 20")


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def postings_all_terms(spark, d):
    """postings_terms without its threshold."""
    index = text_search.postings(_documents(spark, d))
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _bm25_sql(query_text: str, limit: int = 10) -> str:
    times: dict[str, int] = {}
    for w in query_text.split():
        times[w] = times.get(w, 0) + 1
    terms = ", ".join(f"('{w}', {n})" for w, n in times.items())
    return f"""WITH t AS (SELECT doc_id, {_TOKENS} AS tk FROM documents), q(term, times) AS (VALUES {terms}),
stats AS (SELECT count(*) AS n, sum(len(tk)) / count(*) AS avg FROM t),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(tk) AS len, unnest(tk) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
parts AS (SELECT doc_id, times * greatest(0.0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg)) AS p FROM tf JOIN df USING (term) JOIN q USING (term), stats)
SELECT doc_id AS id, round(sum(p), 6) AS score FROM parts GROUP BY doc_id ORDER BY sum(p) DESC, doc_id LIMIT {limit}"""


@query(_bm25_sql("heonthe reing"))
def bm25_search(spark, d):
    return _hits(text_search.bm25(_documents(spark, d), "heonthe reing"))


@query(_bm25_sql("tion tion hean"))
def bm25_repeated_term(spark, d):
    return _hits(text_search.bm25(_documents(spark, d), "tion tion hean"))


@query(f"WITH s AS ({_bm25_sql('the of', 1000000)}) SELECT count(*) AS hits, count(*) FILTER (score = 0) AS zeros FROM s")
def bm25_common_term(spark, d):
    """A term in over half of the documents has weight 0; its documents are hits all the same."""
    found = _hits(text_search.bm25(_documents(spark, d), "the of", 1000000))
    return found.agg(F.count(F.lit(1)).alias("hits"), F.count(F.when(F.col("score") == 0, 1)).alias("zeros"))


@query(_bm25_sql("heonthe reing"))
def bm25_stored_index(spark, d):
    docs = _documents(spark, d)
    index = text_search.read_postings(spark, _stored_postings(spark, d), ["heonthe", "reing"])
    return _hits(text_search.bm25_postings(index, text_search.corpus_stats(docs), "heonthe reing"))


def _sparse(spark, d) -> DataFrame:
    """Token counts of each document as a sparse vector over hashed terms."""
    words = text_search.postings(_documents(spark, d)).groupBy("id", F.crc32("term").cast("bigint").alias("i")).agg(F.sum("tf").cast("float").alias("v"))
    z = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("z"))
    own = F.struct(F.transform("z", lambda x: x["i"]).alias("indices"), F.transform("z", lambda x: x["v"]).alias("values"))
    return z.select("id", F.create_map(F.lit("default"), own).alias("sparse"))


@query(
    f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents)
SELECT doc_id AS id, round(sum(CASE term WHEN 'tion' THEN 2.0 WHEN 'hean' THEN 1.5 ELSE -0.5 END)::DOUBLE, 6) AS score FROM t WHERE term IN ('tion', 'hean', 'reing') GROUP BY doc_id HAVING score > 0 ORDER BY score DESC, doc_id LIMIT 10"""
)
def sparse_search(spark, d):
    import zlib

    weights = [(zlib.crc32(w.encode()), x) for w, x in (("tion", 2.0), ("hean", 1.5), ("reing", -0.5))]
    return _hits(search.sparse_search(_sparse(spark, d), weights))


@query(ORACLES["sparse_search"])
def sparse_search_postings(spark, d):
    """Over a stored index, of which only the query's terms' folders are read."""
    asked = spark.createDataFrame([("tion", 2.0), ("hean", 1.5), ("reing", -0.5)], "index string, value double")
    index = text_search.read_postings(spark, _stored_postings(spark, d), ["tion", "hean", "reing"])
    return _hits(search.sparse_search_postings(index.select("id", F.col("term").alias("index"), F.col("tf").alias("value")), asked))


_STORED: dict[tuple, str] = {}


def _stored_postings(spark, d) -> str:
    """The documents' inverted index, written once an application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        _STORED[key] = scratch(spark, "postings")
        text_search.write_postings(text_search.postings(_documents(spark, d)), _STORED[key])
    return _STORED[key]


@query(
    f"""WITH a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_bm25_sql('heonthe reing', 20)})),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM (SELECT vec_id, {_COS} AS s FROM embeddings) QUALIFY r <= 20)
SELECT id, round(sum(1.0 / (r + 1)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY sum(1.0 / (r + 1)) DESC, id LIMIT 10"""
)
def rrf_hybrid(spark, d):
    """A text leg over documents and a vector leg over embeddings, fused by id. The text leg's ranks are those of its rounded scores."""
    text = _hits(text_search.bm25(_documents(spark, d), "heonthe reing", 20))
    vectors = search.knn(_vectors(spark, d), _vector_of(spark, d), 20).select("id", "score")
    return _hits(fusion.rrf([text, vectors], 10))


# -- filters
@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'scum') OR contains(lower(text), 'moron')")
def filter_text_any(spark, d):
    return search.filtered(_documents(spark, d), {"must": [{"key": "text", "match": {"text": "Scum MORON"}}]}).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (1, 7, 32, 100)")
def filter_has_id(spark, d):
    return search.filtered(_orders(spark, d), {"must": [{"has_id": [1, "7", 32, 100]}]}).select(F.col("o_orderkey").alias("id"))


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").withColumns({"id": F.col("o_orderkey").cast("string"), "id_num": F.col("o_orderkey")})


_BOOL = {"must": [{"key": "o_totalprice", "range": {"gte": 100000, "lt": 300000}}, {"should": [{"key": "o_orderstatus", "match": {"value": "F"}}, {"must": [{"key": "o_orderpriority", "match": {"any": ["1-URGENT", "2-HIGH"]}}, {"field": "o_custkey", "operator": "gt", "value": 50}]}]}], "must_not": [{"key": "o_custkey", "match": {"value": 7}}]}


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 300000 AND (o_orderstatus = 'F' OR (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey > 50)) AND o_custkey <> 7")
def filter_bool_nested(spark, d):
    return search.filtered(_orders(spark, d), _BOOL).select(F.col("o_orderkey").alias("id"))


@query("SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.k')::INT > 50 AND json_extract_string(props, '$.k')::INT <= 60")
def filter_json_path(spark, d):
    flt = {"must": [{"key": "k", "range": {"gt": 50, "lte": 60}}]}
    return search.filtered(table(spark, d, "events"), flt, filters.Json("props")).select(F.col("event_id").alias("id"))


@query("SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.k') IN ('3', '5') OR event_type = 'zzz'")
def filter_json_any(spark, d):
    return search.filtered(table(spark, d, "events"), {"must": [{"key": "k", "match": {"any": [3, 5, "7"]}}]}, filters.Json("props")).select(F.col("event_id").alias("id"))


def _nested(spark, d) -> DataFrame:
    """Orders with their items as a list of objects."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("number"))).alias("items"))
    return items


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2")
def filter_nested_element(spark, d):
    flt = {"must": [{"nested": {"key": "items", "filter": {"must": [{"key": "flag", "match": {"value": "R"}}, {"key": "number", "match": {"value": 2}}]}}}]}
    return search.filtered(_nested(spark, d), flt).select("id")


@query("SELECT l_orderkey AS id FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'A') AND bool_or(l_linenumber = 5)")
def filter_array_path(spark, d):
    flt = {"must": [{"key": "items[].flag", "match": {"value": "A"}}, {"key": "items[].number", "match": {"any": [5]}}]}
    return search.filtered(_nested(spark, d), flt).select("id")


# -- aggregates
@query("SELECT count(*) AS count FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_returnflag = 'R'")
def count_filtered(spark, d):
    return aggregate.count(table(spark, d, "lineitem"), {"must": [{"key": "l_quantity", "range": {"gte": 10, "lte": 20}}, {"key": "l_returnflag", "match": {"value": "R"}}]})


@query("SELECT l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def facet_returnflag(spark, d):
    return aggregate.facet(table(spark, d, "lineitem"), "l_returnflag")


@query("SELECT event_type AS value, count(*) AS count FROM events WHERE value > 50 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def facet_event_type(spark, d):
    return aggregate.facet(table(spark, d, "events"), "event_type", 3, {"must": [{"key": "value", "range": {"gt": 50}}]})


@query("SELECT json_extract_string(props, '$.k') AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def facet_json(spark, d):
    return aggregate.facet(table(spark, d, "events"), aggregate.json_facet_key("props", "$.k"))


@query("SELECT conv_id::VARCHAR AS document, count(*) AS chunks, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS ids FROM conversations GROUP BY conv_id")
def documents_listing(spark, d):
    own = table(spark, d, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").cast("string").alias("conv"))
    return aggregate.list_documents(own, "conv").withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query("SELECT max(o_orderkey) AS max_id FROM orders")
def max_point_id(spark, d):
    return aggregate.max_id(_orders(spark, d))


# -- paging
@query("SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def scroll_first(spark, d):
    return paging.scroll(_orders(spark, d), limit=20).select(F.col("o_orderkey").alias("id"), "o_totalprice")


@query("SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 20")
def scroll_next(spark, d):
    return paging.scroll(_orders(spark, d), 100, 20).select(F.col("o_orderkey").alias("id"), "o_totalprice")


@query("SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey > 50 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20")
def scroll_filtered(spark, d):
    return paging.scroll(_orders(spark, d), 50, 20, {"must": [{"key": "o_orderstatus", "match": {"value": "F"}}]}).select(F.col("o_orderkey").alias("id"), "o_totalprice")


@query("SELECT c_custkey AS id, c_name, p::INT AS position FROM customer JOIN (VALUES (9, 0), (3, 1), (7, 3)) v(k, p) ON c_custkey = k")
def get_by_ids(spark, d):
    own = table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    return paging.get_by_ids(own, [9, 3, -1, 7]).select("id", "c_name", "position")


# -- mutations
_UPSERTED = """WITH w AS (SELECT o_orderkey, o_totalprice, 0 AS ord FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, o_totalprice + 1, 1 FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, o_totalprice + 2, 2 FROM orders WHERE o_orderkey % 4 = 0)
SELECT o_orderkey AS id, round(max_by(o_totalprice, ord), 2) AS price, count(*) - 1 AS version FROM w GROUP BY o_orderkey"""


@query(_UPSERTED)
def upsert_versions(spark, d):
    """A stored batch, then one batch in which some ids occur twice."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    stored = orders.where("id % 3 <> 0").withColumn("version", F.lit(0).cast("bigint"))
    batch = orders.where("id % 2 = 0").select("id", (F.col("price") + 1).alias("price"), F.lit(1).alias("n")).union(orders.where("id % 4 = 0").select("id", F.col("price") + 2, F.lit(2)))
    return mutate.upsert(stored, batch, order_col="n").select("id", F.round("price", 2).alias("price"), "version")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey % 5 <> 0")
def delete_by_ids(spark, d):
    orders = _orders(spark, d)
    gone = orders.where("o_custkey % 5 = 0").select("id")
    return mutate.delete_by_ids(orders, gone).select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 150000)")
def delete_by_filter(spark, d):
    return mutate.delete_by_filter(_orders(spark, d), {"must": [{"key": "o_orderstatus", "match": {"value": "F"}}, {"key": "o_totalprice", "range": {"gt": 150000}}]}).select(F.col("o_orderkey").alias("id"))


def _customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment", "c_acctbal")


_RICH = {"must": [{"key": "c_acctbal", "range": {"gt": 5000}}]}


@query("SELECT c_custkey AS id, c_name, CASE WHEN c_acctbal > 5000 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def set_payload(spark, d):
    return mutate.set_payload(_customers(spark, d), {"c_mktsegment": "RICH"}, flt=_RICH)


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_acctbal > 5000 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def overwrite_payload(spark, d):
    return mutate.overwrite_payload(_customers(spark, d), {"c_mktsegment": "RICH"}, flt=_RICH, payload=["c_name", "c_mktsegment", "c_acctbal"])


@query("SELECT c_custkey AS id, c_name, CASE WHEN c_custkey IN (1, 2, 3) THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def delete_keys(spark, d):
    return mutate.delete_payload_keys(_customers(spark, d), ["c_mktsegment"], ids=[1, 2, 3])


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def clear_payload(spark, d):
    return mutate.clear_payload(_customers(spark, d), ["c_name", "c_mktsegment", "c_acctbal"], flt=_RICH)


@query("SELECT vec_id AS id, round(list_sum(CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: x::DOUBLE * 2) ELSE embedding::DOUBLE[] END), 5) AS total FROM embeddings")
def update_vector(spark, d):
    points = _vectors(spark, d)
    new = points.where("id % 7 = 0").select("id", vm.scale(F.col("vector"), 2.0).alias("vector"))
    own = mutate.update_vectors(points, new)
    return own.select("id", F.round(F.aggregate(vm.doubles(F.col("vector")), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("WITH b AS (SELECT c_custkey AS id, c_name, CASE WHEN c_custkey IN (4, 5) THEN 'X' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (1, 2)) SELECT id, c_name, CASE WHEN id = 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM b")
def batch_update(spark, d):
    points, _ = mutate.batch_update(_customers(spark, d), [{"delete": {"points": [1, 2]}}, {"set_payload": {"payload": {"c_mktsegment": "X"}, "points": [4, 5]}}, {"delete_payload": {"keys": ["c_mktsegment"], "points": [5]}}])
    return points


@query("SELECT count(*) AS affected FROM customer WHERE c_acctbal > 5000")
def affected_rows(spark, d):
    return mutate.affected(_customers(spark, d), flt=_RICH)


# -- vector functions
@query(f"SELECT vec_id AS id, round(list_dot_product({_V}, {_V}), 9) AS norm_squared, round(sqrt(list_dot_product({_V}, {_V})), 9) AS norm FROM embeddings")
def vector_norms(spark, d):
    v = F.col("vector")
    return _vectors(spark, d).select("id", F.round(vm.norm_squared(v), 9).alias("norm_squared"), F.round(vm.norm(v), 9).alias("norm"))


@query(f"SELECT vec_id AS id, round(list_dot_product(u, u), 9) AS norm_squared, round(u[1], 9) AS first FROM (SELECT vec_id, list_transform({_V}, lambda x: x * 3 / sqrt(list_dot_product({_V}, {_V}) * 9)) AS u FROM embeddings)")
def vector_normalize(spark, d):
    own = _vectors(spark, d).select("id", vm.normalize(vm.scale(F.col("vector"), 3.0)).alias("u"))
    return own.select("id", F.round(vm.norm_squared(F.col("u")), 9).alias("norm_squared"), F.round(F.get("u", F.lit(0)), 9).alias("first"))


@query("SELECT label, (pos - 1)::INT AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos")
def vector_mean(spark, d):
    means = vm.vector_mean(_vectors(spark, d), "vector", ["label"])
    return means.select("label", F.posexplode("mean").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("mean"))


@query(f"SELECT vec_id AS id, round(list_sum(list_transform(list_zip({_V}, {_Q0}), lambda z: (z[1] + z[2]) - (z[1] - z[2]) * 0.5)), 6) AS total FROM embeddings")
def vector_arithmetic(spark, d):
    q = vm.literal_vector(_vector_of(spark, d))
    v = F.col("vector")
    out = vm.subtract(vm.add(v, q), vm.scale(vm.subtract(v, q), 0.5))
    return _vectors(spark, d).select("id", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# -- examples' functions
@query("SELECT p_partkey AS id, concat_ws('. ', 'p_name: ' || p_name, 'p_brand: ' || p_brand, 'p_type: ' || p_type) AS text FROM part")
def composite_text(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), textfn.composite_text(["p_name", "p_brand", "p_type"]).alias("text"))


# One step of the cut for every text at a time: windows begin at `at`, and end at a mark past their half, or whole.
_CHUNKS = """WITH RECURSIVE d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, t, 0 AS pos, -1 AS n, '' AS chunk FROM d WHERE length(t) > 1000
  UNION ALL
  SELECT id, t, pos + stop - 200, n + 1, substr(t, pos + 1, stop) FROM (
    SELECT id, t, pos, n, CASE WHEN pos + 1000 >= length(t) THEN 1000 WHEN para > 500 THEN para WHEN dot > 500 THEN dot + 1 ELSE 1000 END AS stop FROM (
      SELECT *, CASE WHEN contains(x, chr(10) || chr(10)) THEN length(x) - strpos(reverse(x), chr(10) || chr(10)) - 1 ELSE -1 END AS para,
        CASE WHEN contains(x, '. ') THEN length(x) - strpos(reverse(x), ' .') - 1 ELSE -1 END AS dot
      FROM (SELECT *, substr(t, pos + 1, 1000) AS x FROM w WHERE pos < length(t)))))
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY n) - 1)::INT AS chunk_index, chunk FROM (
  SELECT id, n, trim(chunk, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS chunk FROM w WHERE n >= 0
  UNION ALL SELECT id, 0, t FROM d WHERE length(t) <= 1000) WHERE trim(chunk, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''"""


@query(_CHUNKS)
def chunk_text(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return textfn.chunk_text(docs).select("id", "chunk_index", "chunk")


@query(f"WITH h AS ({_bm25_sql('heonthe reing', 3)}) SELECT string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY score DESC, id) AS context FROM h JOIN documents ON doc_id = id")
def rag_context(spark, d):
    docs = _documents(spark, d)
    hits = _hits(text_search.bm25(docs, "heonthe reing", 3)).join(docs.select("id", "text"), "id")
    return textfn.rag_context(hits, "text")


_PAGE = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g')"
_PAGE = f"regexp_replace(regexp_replace({_PAGE}, '(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _PAGE = f"replace({_PAGE}, '{_entity}', '{_char}')"
_PAGE = f"trim(regexp_replace(regexp_replace({_PAGE}, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


@query(f"SELECT page_id AS id, url, {_PAGE} AS text FROM pages")
def page_text(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", ingest.html_text(F.col("html")).alias("text"))


# -- tables and indexes
@query("SELECT vec_id::VARCHAR AS id, vec_id AS id_num, 0::BIGINT AS version, label FROM embeddings")
def snapshot_roundtrip(spark, d):
    """Into a collection, a snapshot of it, and the collection recovered from that."""
    from pointsmith.operators.points import CollectionConfig
    from pointsmith.sources.catalog import Catalog

    catalog = Catalog(spark, scratch(spark, "catalog"))
    catalog.create_collection(CollectionConfig("vectors", 64))
    catalog.write("vectors", as_points(table(spark, d, "embeddings"), "vec_id", "embedding"))
    label = catalog.create_snapshot("vectors")
    catalog.write("vectors", catalog.points("vectors").where("id_num < 10"))
    catalog.recover_snapshot("vectors", label)
    return catalog.points("vectors").select("id", "id_num", "version", "payload.label")


@query()
def ann_ivf(spark, d):
    from pointsmith.operators import ann

    path = scratch(spark, "ann")
    points = _vectors(spark, d)
    centres = ann.build(points, path)
    index = spark.read.parquet(f"{path}/cells")
    asked = points.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    return ann.search_batch(index, centres, asked).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    """Events as a stream, counted by the hour and type until the input is used up."""
    from pointsmith.streaming.upserts import latest_counts, read_latest, windowed_counts

    schema = table(spark, d, "events").schema
    base = scratch(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("at", F.col("ts").cast("timestamp"))
    # The whole input is one batch, so its end is a watermark only the next batch would see: open windows count too.
    counts = windowed_counts(stream, "at", "event_type", late="0 seconds").withColumnRenamed("end", "stop")
    latest_counts(counts, f"{base}/table", f"{base}/checkpoint", ["start", "event_type"]).awaitTermination()
    found = read_latest(spark, f"{base}/table", ["start", "event_type"])
    return found.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


# -- batches, groups and other forms of the universal query
@query(f"SELECT query_id, id, round(s, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, p.vec_id AS id, list_cosine_similarity(p.{_V}, q.{_V}) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(p.{_V}, q.{_V}) DESC, p.vec_id)::INT AS rank FROM embeddings p, embeddings q) WHERE rank <= 10")
def knn_batch_all(spark, d):
    """Every vector as a query against all."""
    points = _vectors(spark, d)
    found = search.knn_batch(points, points.select(F.col("id").alias("query_id"), F.col("vector").alias("q")))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_LEGS = f"""SELECT 0 AS query_no, * FROM ({_knn_sql(where="label = 2", k=5)})
UNION ALL SELECT 1, * FROM ({_knn_sql(where="vec_id <> 0", k=7)})
UNION ALL SELECT 2, * FROM (SELECT id, score FROM ({_knn_sql(k=8)}) OFFSET 3)"""


@query(_LEGS)
def query_batch(spark, d):
    """A filtered vector, an id, and a vector with an offset, as one batch."""
    q = _vector_of(spark, d)
    asked = [{"query": q, "limit": 5, "filter": {"must": [{"key": "label", "match": {"value": 2}}]}}, {"query": 0, "limit": 7}, {"query": q, "limit": 5, "offset": 3}]
    return search.query_batch(_vectors(spark, d), asked).select("query_no", "id", F.round("score", 6).alias("score"))


@query(f"""SELECT 0 AS query_no, * FROM ({_knn_sql(where="label < 5", k=6)})
UNION ALL SELECT 1, id, score FROM ({ORACLES["discover_context"]})""")
def discover_batch(spark, d):
    asked = [{"target": 0, "limit": 6, "filter": {"must": [{"key": "label", "range": {"lt": 5}}]}}, {"target": 0, "context": [(1, 2), (3, 4)]}]
    return search.discover_batch(_vectors(spark, d), asked).select("query_no", "id", F.round("score", 6).alias("score"))


@query(ORACLES["search_groups"].replace("FROM embeddings ORDER BY s", "FROM embeddings WHERE vec_id <> 0 ORDER BY s"))
def query_groups(spark, d):
    """Groups over a query by id."""
    return _hits(search.query_groups(_vectors(spark, d), {"query": 0}, "label", limit=4, group_size=3), "group", "rank", "group_rank")


@query(f"SELECT id, score FROM ({_bm25_sql('heonthe reing', 1000000)}) JOIN documents ON doc_id = id WHERE source = (SELECT min(source) FROM documents) ORDER BY score DESC, id LIMIT 10")
def bm25_filtered(spark, d):
    """Text search with a filter: statistics are those of all documents."""
    docs = _documents(spark, d)
    source = docs.agg(F.min("source")).first()[0]
    return _hits(text_search.bm25(docs, "heonthe reing", flt={"must": [{"key": "source", "match": {"value": source}}]}))


@query(f"SELECT id, score FROM ({_bm25_sql('heonthe reing', 12)}) ORDER BY score DESC, id LIMIT 8 OFFSET 4")
def query_text(spark, d):
    """Text as a form of the universal query, with an offset."""
    return _hits(search.query(_documents(spark, d), {"query": {"text": "heonthe reing"}, "limit": 8, "offset": 4}))


@query(f"SELECT id, score FROM ({ORACLES['sparse_search']}) WHERE score >= 3 ORDER BY score DESC, id LIMIT 6 OFFSET 2")
def query_sparse_page(spark, d):
    """A sparse vector as a form of the universal query, with threshold and offset."""
    import zlib

    words = {"tion": 2.0, "hean": 1.5, "reing": -0.5}
    asked = {"indices": [zlib.crc32(w.encode()) for w in words], "values": list(words.values())}
    return _hits(search.query(_sparse(spark, d), {"query": asked, "limit": 6, "offset": 2, "score_threshold": 3.0}))


@query(ORACLES["maxsim_dot"])
def query_multivector(spark, d):
    points = _multi(spark, d).withColumn("vector", F.lit(None).cast("array<float>"))
    return _hits(search.query(points, {"query": [_vector_of(spark, d, 0), _vector_of(spark, d, 1)]}, "Dot"))


@query("SELECT count(*) AS n_queries, true AS recalled, true AS few_read FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(spark, d):
    """Binary codes against exact search, queries with ids divisible by 20: recall@10 of 0.9 or more, and at most 20% of
    the rows ranked by their vectors (4.4 times the root of the rows, 100 at least)."""
    from pointsmith.operators import ann

    points = _vectors(spark, d)
    asked = points.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    index = cut(spark, ann.with_codes(points, len(_vector_of(spark, d))))
    found, exact = ann.search_codes(index, asked), search.knn_batch(points, asked)
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    rows = index.count()
    return both.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recalled"), F.lit(ann.candidates(rows, 10) <= max(100, 0.2 * rows)).alias("few_read"))


@query(ORACLES["knn_cosine"])
def search_strategy(spark, d):
    """The dispatcher: few rows are searched exactly, whether there is an index or not."""
    from pointsmith.operators import ann

    points = _vectors(spark, d)
    one = points.where("id = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    return _hits(ann.search_any(points, one, exact_rows=10**9))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (1, 2, 3)")
def ann_remove(spark, d):
    from pointsmith.operators import ann

    return ann.remove(_vectors(spark, d), [1, 2, 3]).select("id")


@query("SELECT vec_id // 4 AS id, count(*)::INT AS n_rows, true AS whole, 64 AS width, round(min_by(embedding::DOUBLE[], vec_id)[1], 6) AS first FROM embeddings GROUP BY 1")
def multivector_accessors(spark, d):
    mv = F.col("multivector")
    return _multi(spark, d).select("id", F.size(mv).alias("n_rows"), vm.is_multivector(mv).alias("whole"), vm.dim(vm.first(mv)).alias("width"), F.round(F.get(vm.first(mv), F.lit(0)).cast("double"), 6).alias("first"))


# -- more of the filter language
@query("SELECT doc_id AS id FROM documents WHERE contains(text, 'The ')")
def filter_contains(spark, d):
    """A part of a text as it is written."""
    return search.filtered(_documents(spark, d), {"must": [{"key": "text", "match": {"contains": "The "}}]}).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice >= 200000 AND o_orderkey % 3 = 1 AND NOT (o_custkey % 2 = 0)")
def filter_own_column(spark, d):
    """Conditions of the caller's own, as Columns within a filter."""
    flt = {"must": [{"key": "o_totalprice", "range": {"gte": 200000}}, F.col("o_orderkey") % 3 == 1], "must_not": [F.col("o_custkey") % 2 == 0]}
    return search.filtered(_orders(spark, d), flt).select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 300000")
def filter_legacy(spark, d):
    return search.filtered(_orders(spark, d), {"field": "o_totalprice", "operator": "gt", "value": 300000}).select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def filter_legacy_ne(spark, d):
    return search.filtered(_orders(spark, d), {"field": "o_orderstatus", "operator": "ne", "value": "F"}).select(F.col("o_orderkey").alias("id"))


@query("SELECT count(*) FILTER (false) AS unknown, count(*) AS negated, count(*) AS nothing FROM orders")
def filter_unknown(spark, d):
    """Unknown conditions and keys are false, also under a negation; no filter keeps all."""
    orders = _orders(spark, d)
    n = lambda flt: search.filtered(orders, flt).count()
    return spark.createDataFrame([(n({"must": [{"key": "o_custkey", "near": 1}]}), n({"must_not": [{"key": "nowhere", "match": {"value": 1}}]}), n({}))], "unknown long, negated long, nothing long")


@query("SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.k')::INT IN (1, 2, 3)")
def filter_array_any(spark, d):
    """A list in the payload against a list of wanted values."""
    own = table(spark, d, "events").select(F.col("event_id").alias("id"), F.array(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("ks"))
    return search.filtered(own, {"must": [{"key": "ks", "match": {"any": [1, 2, 3]}}]}).select("id")


# -- projections
def _payload(spark, d) -> DataFrame:
    return as_points(table(spark, d, "part"), "p_partkey")


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name, p_size AS size FROM part")
def project_fields(spark, d):
    out = search.project(_payload(spark, d), ["p_name", "p_size"])
    return out.select("id", F.col("payload.p_name").alias("name"), F.col("payload.p_size").alias("size"))


@query("SELECT p_partkey::VARCHAR AS id, 5 AS n_fields, false AS has_vector FROM part")
def project_exclude(spark, d):
    out = search.project(_payload(spark, d), {"exclude": ["p_retailprice"]})
    return out.select("id", F.lit(len(out.schema["payload"].dataType.fieldNames())).alias("n_fields"), F.lit("vector" in out.columns).alias("has_vector"))


@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 2 = 0 THEN '{}' ELSE '{\"a\":1}' END AS scrolled, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE '{\"a\":1}' END AS got FROM part")
def project_missing(spark, d):
    """A missing payload: null in search and get, {} in scroll."""
    own = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 2 != 0, F.lit('{"a":1}')).alias("payload"))
    scrolled = search.project(own, missing="empty").withColumnRenamed("payload", "scrolled")
    return scrolled.join(search.project(own).withColumnRenamed("payload", "got"), "id")


# -- JSON payload edits
_JSON_EVENTS = "SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT AS k"


def _json_events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("payload"), "event_type")


@query(_JSON_EVENTS + ", CASE WHEN event_type = 'click' THEN 'yes' END AS seen FROM events")
def set_payload_json(spark, d):
    out = mutate.set_payload(_json_events(spark, d), {"seen": "yes"}, flt={"must": [{"key": "event_type", "match": {"value": "click"}}]}, payload="payload")
    return out.select("id", F.get_json_object("payload", "$.k").cast("long").alias("k"), F.get_json_object("payload", "$.seen").alias("seen"))


@query("SELECT event_id AS id, CASE WHEN event_id < 100 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events")
def delete_keys_json(spark, d):
    own = _json_events(spark, d)
    out = mutate.delete_payload_keys(own, ["k"], flt={"must": [{"key": "id", "range": {"lt": 100}}]}, payload="payload")
    return out.select("id", F.get_json_object("payload", "$.k").cast("long").alias("k"))


@query("SELECT event_id AS id, CASE WHEN event_id < 100 THEN '{\"z\": 1}' END AS payload FROM events")
def overwrite_and_clear_json(spark, d):
    out = mutate.overwrite_payload(_json_events(spark, d), {"z": 1}, flt={"must": [{"key": "id", "range": {"lt": 100}}]})
    return mutate.clear_payload(out, "payload", flt={"must": [{"key": "id", "range": {"gte": 100}}]}).select("id", "payload")


@query("SELECT vec_id // 4 AS id, CASE WHEN vec_id // 4 < 10 THEN NULL ELSE count(*)::INT END AS n_rows FROM embeddings GROUP BY vec_id // 4")
def delete_multivectors(spark, d):
    out = mutate.delete_vectors(_multi(spark, d), ["multivector"], flt={"must": [{"key": "id", "range": {"lt": 10}}]})
    return out.select("id", F.when(F.col("multivector").isNotNull(), F.size("multivector")).alias("n_rows"))


# -- SQL functions and tools
@query(f"SELECT vec_id AS id, round(list_dot_product({_V}, {_Q0}), 6) AS dot, round({_COS}, 6) AS cosine, round(list_distance({_V}, {_Q0}), 6) AS l2 FROM embeddings")
def sql_functions(spark, d):
    """The scalar functions, called from SQL."""
    from pointsmith.functions import sqlfn

    sqlfn.register(spark)
    view = scratch_name("vectors")
    _vectors(spark, d).select("id", F.col("vector").cast("array<double>").alias("v")).createOrReplaceTempView(view)
    q = f"(SELECT first(v) FROM {view} WHERE id = 0)"
    return spark.sql(f"SELECT id, round(vec_dot(v, {q}), 6) AS dot, round(vec_cosine(v, {q}), 6) AS cosine, round(vec_l2(v, {q}), 6) AS l2 FROM {view}")


@query(ORACLES["tokenize_counts"])
def sql_tokens(spark, d):
    from pointsmith.functions import sqlfn

    sqlfn.register(spark)
    view = scratch_name("documents")
    _documents(spark, d).select("id", "text").createOrReplaceTempView(view)
    return spark.sql(f"SELECT id, size(t) AS n_tokens, size(array_distinct(t)) AS n_terms FROM (SELECT id, text_tokens(text) AS t FROM {view})")


@query("SELECT count(*) AS count FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 10 AND l_quantity < 20 AND l_linestatus = 'F'")
def tool_count_records(spark, d):
    from pointsmith.operators.tools import Tools

    return Tools(table(spark, d, "lineitem")).count_records({"l_returnflag": ["A", "R"], "l_quantity": {"gte": 10, "lt": 20}, "l_linestatus": "F"})


@query(_knn_sql(where="label IN (1, 2)"))
def tool_vector_search(spark, d):
    from pointsmith.operators.tools import Tools

    return _hits(Tools(_vectors(spark, d)).vector_search(_vector_of(spark, d), {"label": [1, 2]}))


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'P')")
def tool_delete_records(spark, d):
    from pointsmith.operators.tools import Tools

    return Tools(_orders(spark, d)).delete_records({"o_orderstatus": "P"}).select(F.col("o_orderkey").alias("id"))


# -- sources
def _bytes_of_text(spark, df: DataFrame, kind: str, **options) -> str:
    path = scratch(spark, kind)
    getattr(df.write, kind)(path, **options)
    return path


@query("SELECT vec_id::VARCHAR AS id, vec_id AS id_num, len(embedding)::INT AS width, label, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def read_json_points(spark, d):
    """Points as JSON lines, written and read back."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.struct("label").alias("payload"))
    back = ingest.read_points_json(spark, _bytes_of_text(spark, own, "json"))
    return back.select("id", "id_num", F.size("vector").alias("width"), F.get_json_object("payload", "$.label").cast("int").alias("label"), F.round(F.col("vector")[0].cast("double"), 5).alias("first"))


@query("SELECT s_suppkey::DOUBLE AS s_suppkey, s_name, s_nationkey::DOUBLE AS s_nationkey, s_acctbal FROM supplier")
def read_csv_table(spark, d):
    """A CSV with kinds found by looking at all cells."""
    return ingest.read_csv(spark, _bytes_of_text(spark, table(spark, d, "supplier"), "csv", header=True))


@query("SELECT item_id, text FROM benchmark")
def read_text_files(spark, d):
    """A folder of text files, a file a document."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("value"))
    path = scratch(spark, "texts")
    rows.write.partitionBy("item").text(path, lineSep="\x00")
    read = ingest.read_texts(spark, f"{path}/item=*")
    return read.select(F.regexp_extract("path", "item=([0-9]+)", 1).cast("long").alias("item_id"), F.replace("text", F.lit("\x00"), F.lit("")).alias("text"))


def _catalog(spark, d):
    from pointsmith.operators.points import CollectionConfig
    from pointsmith.sources.catalog import Catalog

    catalog = Catalog(spark, scratch(spark, "catalog"))
    catalog.create_collection(CollectionConfig("vectors", 64))
    return catalog


@query("SELECT 'vectors' AS name, true AS direct, true AS renamed, false AS gone, 'label:integer' AS indexes, 3::BIGINT AS operations, count(*) FILTER (vec_id >= 5) AS points FROM embeddings")
def catalog_calls(spark, d):
    """Collections, aliases, payload indexes and the operation counter."""
    catalog = _catalog(spark, d)
    points = as_points(table(spark, d, "embeddings"), "vec_id", "embedding")
    catalog.write("vectors", points)
    catalog.create_alias("old", "vectors")
    catalog.rename_alias("old", "new")
    catalog.create_payload_index("new", "label", "integer")
    catalog.write("new", points)
    last = catalog.write("new", mutate.delete_by_ids(catalog.points("new"), list(range(5))))
    row = (catalog.list_collections()[0], catalog.collection_exists("vectors"), catalog.list_aliases("vectors") == {"new": "vectors"}, catalog.collection_exists("old"), ",".join(f"{k}:{v}" for k, v in catalog.get_payload_indexes("vectors").items()), last, catalog.points("new").count())
    return spark.createDataFrame([row], "name string, direct boolean, renamed boolean, gone boolean, indexes string, operations long, points long")


@query("SELECT vec_id::VARCHAR AS id, label FROM embeddings")
def dump_roundtrip(spark, d):
    """The whole database saved twice to one path, and loaded."""
    catalog = _catalog(spark, d)
    path = scratch(spark, "dump")
    catalog.save_all(path)
    catalog.write("vectors", as_points(table(spark, d, "embeddings"), "vec_id", "embedding"))
    catalog.save_all(path)
    catalog.delete_collection("vectors")
    catalog.load_all(path)
    return catalog.points("vectors").select("id", "payload.label")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def import_snapshot_file(spark, d):
    """A snapshot as one gzipped JSON file, uploaded with its checksum."""
    import gzip
    import hashlib
    import json

    catalog = _catalog(spark, d)
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 rows at any size
    body = gzip.compress(json.dumps({"config": {"vector_dim": 0}, "points": [{"id": r[0], "payload": {"name": r[1]}} for r in rows]}).encode())
    catalog.upload_snapshot("nations", body, hashlib.sha256(body).hexdigest())
    return catalog.points("nations").select("id", F.get_json_object("payload", "$.name").alias("name"))


@query("SELECT o_orderkey AS id, o_totalprice + 1 AS price FROM orders")
def stream_upserts(spark, d):
    """A stream of orders into a collection, started twice: each batch counts once."""
    from pointsmith.operators.points import CollectionConfig
    from pointsmith.sources.catalog import Catalog
    from pointsmith.streaming import upserts

    catalog = Catalog(spark, scratch(spark, "catalog"))
    catalog.create_collection(CollectionConfig("orders", 0))
    schema = table(spark, d, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d).select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + 1).alias("price"), F.lit(None).cast("array<float>").alias("vector"))
    checkpoint = scratch(spark, "checkpoint")
    for _ in range(2):
        upserts.stream_upserts(stream, catalog, "orders", checkpoint).awaitTermination()
    return catalog.points("orders").where("version = 0").select("id", "price")


@query("SELECT 'ok' AS health, 'ready' AS ready, 0 AS issues")
def service_constants(spark, d):
    from pointsmith.sources.catalog import SERVICE

    return spark.createDataFrame([(SERVICE["health"]["status"], SERVICE["ready"]["status"], len(SERVICE["issues"]["issues"]))], "health string, ready string, issues int")
