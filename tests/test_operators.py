import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointsmith.functions import textfn
from pointsmith.operators import aggregate, ann, fusion, mutate, paging, points, search, text_search
from pointsmith.operators.points import CollectionConfig
from pointsmith.session import table
from pointsmith.sources import ingest
from pointsmith.sources.catalog import Catalog
from pointsmith.streaming.upserts import stream_upserts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def diagonal(spark):
    return points.points_from_records(spark, [{"id": i, "vector": [i, i, i], "payload": {"category": "A" if i % 2 == 0 else "B"}} for i in range(1, 11)])


def test_knn_and_plans(spark, diagonal):
    found = search.knn(diagonal, [5.0, 5.0, 5.0], 3)
    assert found.count() == 3 and all(r["score"] > 0.9 for r in found.collect())
    assert "TakeOrderedAndProject" in plan(found)
    assert [r["id"] for r in search.knn(diagonal, [5.0, 5.0, 5.0], 3, "Euclidean").collect()] == ["5", "4", "6"]
    batch = search.knn_batch(diagonal, spark.createDataFrame([(1, [1.0, 1.0, 1.0])], "query_id int, q array<float>"), 2)
    assert "WindowGroupLimit" in plan(batch) and batch.count() == 2


def test_query_dispatch(spark):
    pts = points.points_from_records(spark, [{"id": "a", "vector": {"dense": [1, 0], "kw": {"indices": [1, 2], "values": [1, 2]}}}, {"id": "b", "vector": [[0, 1], [1, 0]]}, {"id": "c", "vector": None}])
    run = lambda q, **k: [(r["id"], round(r["score"], 6)) for r in search.query(pts, {"query": q, **k}).collect()]
    assert run([1.0, 0.0]) == [("a", 1.0), ("b", 0.0)]
    assert run({"indices": [2], "values": [3.0]}, using="kw") == [("a", 6.0)]
    assert run([[1.0, 0.0]])[0][1] == 1.0
    assert run("a") == [("b", 0.0)]
    fused = search.query(pts, {"query": {"fusion": "rrf"}, "prefetch": [{"query": [1.0, 0.0]}, {"query": [[0.0, 1.0]]}]})
    assert [r["id"] for r in fused.collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        search.query(pts, {"query": {"fusion": "rrf"}})


def test_recommend_edges(diagonal):
    assert search.recommend(diagonal, ["404"], distance="Dot").count() == 0
    assert "1" not in [r["id"] for r in search.recommend(diagonal, ["1", "404"], ["2"], distance="Dot").collect()]
    assert search.knn_by_id(diagonal, "404").count() == 0


def test_groups_unknown(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.9, 0.1], None), ("c", [0.0, 1.0], "x")], "id string, vector array<float>, g string")
    assert {r["group"] for r in search.search_groups(df, [1.0, 0.0], "g").collect()} == {"x", "unknown"}


def test_parse_vector_forms():
    assert points.parse_vector([])["vector"] is None
    assert points.parse_vector({"indices": [1], "values": [2]})["vector"] == [0.0]
    assert points.parse_vector({"a": [1], "b": [2, 3]})["vector"] == [2.0, 3.0]
    with pytest.raises(ValueError):
        points.parse_vector([[1], [2, 3]])


def test_rrf_order_does_not_matter(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "id string, score double")
    b = spark.createDataFrame([("y", 9.0), ("z", 1.0)], "id string, score double")
    one, two = ([tuple(r) for r in fusion.rrf(legs).collect()] for legs in ([a, b], [b, a]))
    assert one == two and one[0] == ("y", pytest.approx(1 / 3 + 1 / 2))


def test_bm25_common_term_is_zero(spark):
    docs = spark.createDataFrame([(f"doc{i}", f"document about topic {i}") for i in range(10)], "id string, text string")
    found = text_search.bm25(docs, "topic").collect()
    assert len(found) == 10 and all(r["score"] == 0 for r in found)
    assert text_search.bm25(docs, "nothing").count() == 0


def test_tokenizer(spark):
    one = lambda t: spark.range(1).select(textfn.tokenize(F.lit(t)).alias("t")).first()["t"]
    assert one("Hello, WORLD! a é x1 —dash—") == ["hello", "world", "é", "x1", "dash"]


def test_chunks():
    text = "A. " * 700
    parts = textfn.chunks_of(text, 1000, 200)
    assert all(len(p) <= 1000 for p in parts) and parts[0].endswith(".") and len(parts) == 3
    assert textfn.chunks_of("", 10, 2) == [] and textfn.chunks_of("ab", 10, 2) == ["ab"]
    assert "".join(textfn.chunks_of("x" * 25, 10, 0)) == "x" * 25


def test_embed_blank_is_zero(spark):
    rows = textfn.embed(spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "id int, text string"), dim=8).orderBy("id").collect()
    assert abs(sum(x * x for x in rows[0]["vector"]) - 1) < 1e-6 and rows[1]["vector"] == rows[2]["vector"] == [0.0] * 8


def test_scroll_pages(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("10", 10), ("9", 9)], "id string, id_num bigint")
    page, after = paging.scroll_page(df, None, 3)
    assert [r["id"] for r in page] == ["9", "10", "a"] and after == (None, "a")
    page, after = paging.scroll_page(df, after, 3)
    assert [r["id"] for r in page] == ["b"] and after is None


def test_upsert_versions(spark, diagonal):
    new = points.points_from_records(spark, [{"id": 1, "vector": [0, 0, 1]}, {"id": 1, "vector": [0, 1, 1]}, {"id": 99, "vector": [1, 1, 1]}]).withColumn("n", F.monotonically_increasing_id())
    stored = diagonal.withColumn("version", F.lit(0).cast("bigint"))
    out = {r["id"]: r for r in mutate.upsert(stored, new, order_col="n").collect()}
    assert out["1"]["version"] == 2 and out["1"]["vector"] == [0, 1, 1] and out["99"]["version"] == 0 and len(out) == 11


def test_json_payload_edits(spark):
    df = spark.createDataFrame([("1", '{"a":1,"q\\"x":[1,2]}'), ("2", None)], "id string, payload string")
    got = {r["id"]: json.loads(r["payload"]) for r in mutate.set_payload(df, {"b": "ü", "a": None}, payload="payload").collect()}
    assert got == {"1": {'q"x': [1, 2], "b": "ü", "a": None}, "2": {"b": "ü", "a": None}}
    gone = {r["id"]: r["payload"] for r in mutate.delete_payload_keys(df, ["a"], ids=["1"], payload="payload").collect()}
    assert json.loads(gone["1"]) == {'q"x': [1, 2]} and gone["2"] is None


def test_batch_update_statuses(diagonal):
    out, status = mutate.batch_update(diagonal, [{"delete": {"points": [1]}}, {"nonsense": {}}])
    assert status == ["completed", "unknown operation"] and out.count() == 9


def test_facet_approx(spark):
    df = spark.createDataFrame([(x,) for x in "aaabbc"], "k string")
    exact = [tuple(r) for r in aggregate.facet(df, "k", 2).collect()]
    assert exact == [("a", 3), ("b", 2)] == [tuple(r) for r in aggregate.facet(df, "k", 2, exact=False).collect()]


def test_catalog(spark, diagonal, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/db")
    cat.create_collection(CollectionConfig("c", 3, "Dot"))
    cat.create_alias("al", "c")
    cat.upsert("al", diagonal)
    assert cat.points("al").count() == 10 and cat.get_config("al").distance == "Dot"
    with pytest.raises(Exception, match="dimension mismatch"):
        cat.upsert("c", points.points_from_records(spark, [{"id": 1, "vector": [1, 2]}, {"id": 77, "vector": [1, 2, 3]}]))
    assert cat.points("c").count() == 10  # all or nothing
    label = cat.create_snapshot("c")
    cat.write("c", cat.points("c").limit(1))
    cat.recover_snapshot("c", label)
    assert cat.points("c").count() == 10 and cat.list_snapshots("c") == [label]
    cat.create_payload_index("c", "category", "Keyword")
    assert cat.get_payload_indexes("al") == {"category": "keyword"}
    cat.save_all(f"file://{tmp_path}/dump")
    cat.delete_collection("c")
    assert not cat.collection_exists("al")
    cat.load_all(f"file://{tmp_path}/dump")
    assert cat.points("al").count() == 10 and "points_total 10" in cat.metrics()
    assert cat.import_bytes("other", b'{"points": [{"id": 1, "vector": [1]}]}') == "json" and cat.points("other").count() == 1
    with pytest.raises(ValueError):
        cat.import_bytes("other", b"{}", checksum="00")


def test_stream_upserts(spark, diagonal, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/db")
    cat.create_collection(CollectionConfig("c", 3))
    diagonal.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(diagonal.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_upserts(stream, cat, "c", f"file://{tmp_path}/cp").awaitTermination()
    assert cat.points("c").count() == 10


def test_ann_recall(spark, data):
    pts = table(spark, data, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    path = f"/tmp/ann-{uuid.uuid4().hex}"
    centres = ann.build(pts, path)
    index = spark.read.parquet(f"{path}/cells")
    assert index.count() == pts.count()
    got = []
    for r in pts.where("id % 100 = 0").collect():
        exact = [x["id"] for x in search.knn(pts, r["vector"], 10).collect()]
        got.append(ann.recall(exact, [x["id"] for x in ann.search(index, centres, r["vector"], 10, probes=int(len(centres) * 0.75)).collect()]))
    assert sum(got) / len(got) >= 0.9
    assert "PartitionFilters: [isnotnull(cell" in plan(ann.search(index, centres, [1.0] * 64, 10, 2)) or "PartitionFilters" in plan(ann.search(index, centres, [1.0] * 64, 10, 2))


def test_ann_recall_as_registered(spark, data):
    """The registered query, and single searches by default, against brute force."""
    from pointsmith.plans import registry

    def by_query(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["query_id"], []).append(r["id"])
        return out

    exact = by_query(registry.queries()["knn_batch"](spark, data))
    found = by_query(registry.queries()["ann_ivf"](spark, data))
    assert set(found) == set(exact) and len(exact) == 25
    assert sum(ann.recall(exact[i], found[i]) for i in exact) / len(exact) >= 0.9
    pts = table(spark, data, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path = f"/tmp/ann-{uuid.uuid4().hex}"
    centres = ann.build(pts, path)
    index = spark.read.parquet(f"{path}/cells")
    got = [ann.recall(exact[r["id"]], [x["id"] for x in ann.search(index, centres, r["vector"]).collect()]) for r in pts.where("id % 20 = 0").collect()]
    assert sum(got) / len(got) >= 0.9


@pytest.mark.parametrize("distance", ["Cosine", "Dot", "Euclidean"])
def test_ann_batch_by_cells(spark, tmp_path, distance, monkeypatch):
    """A batch gives what single searches give, without a row for each pair of query and point; equal vectors come by id."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8)).round(3)
    x[100:200] = x[100]
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(5)
    centres = ann.build(pts, f"file://{tmp_path}/ann", cells=12)
    index = spark.read.parquet(f"file://{tmp_path}/ann/cells")
    asked = pts.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    monkeypatch.setattr(ann, "QUERY_BYTES", 10 * (12 + 8 * 8), raising=False)
    found = ann.search_batch(index, centres, asked, 10, 4, distance)
    assert "Join" not in plan(found)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert len(got) == 30
    for i in (0, 100, 160, 340):
        one = ann.search(index, centres, x[i].astype(np.float32).tolist(), 10, 4, distance).collect()
        assert got[i] == [(r["id"], round(r["score"], 6)) for r in one]
    assert [i for i, _ in got[160]][:5] == [100, 101, 102, 103, 104] or distance == "Dot"
    assert ann.search_batch(index, centres, asked.where("false"), 10, 4, distance).isEmpty()
    assert ann.search_batch(index, centres, asked, 0, 4, distance).isEmpty()
    named = index.withColumn("id", F.concat(F.lit("p"), "id"))
    texts = {(r["query_id"], r["rank"]): r["id"] for r in ann.search_batch(named, centres, asked, 3, 4, distance, {"must": [{"key": "id", "match": {"value": "p100"}}]}).collect()}
    assert set(texts.values()) == {"p100"} and texts[160, 1] == "p100"


def test_postings_of_all_terms(spark, data):
    """The registered index has the rare terms too."""
    from pointsmith.plans import registry

    terms = registry.queries()["postings_all_terms"](spark, data).cache()
    frequent = registry.queries()["postings_terms"](spark, data).count()
    assert terms.where("df >= 20").count() == frequent < terms.count() and terms.where("df = 1").count() > 0


def test_csv_and_json_ingest(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,name,price,ok\n1,"Ham",2.5,true\n2,,3,false\nbroken,row\n3,Egg,x,true\n')
    df = ingest.read_csv(spark, f"file://{tmp_path}/p.csv")
    assert dict(df.dtypes) == {"id": "double", "name": "string", "price": "string", "ok": "boolean"} and df.count() == 3
    (tmp_path / "p.json").write_text('{"id": "1", "vector": [1, 2], "payload": {"a": 1}}\n{"id": "2", "vector": [[1], [2]]}\n{"id": "3", "vector": {"kw": {"indices": [5], "values": [0.5]}, "d": [7]}}\n{"id": "4", "vector": null}\n')
    got = {r["id"]: r for r in ingest.read_points_json(spark, f"file://{tmp_path}/p.json").collect()}
    assert got["1"]["vector"] == [1, 2] and json.loads(got["1"]["payload"]) == {"a": 1}
    assert got["2"]["multivector"] == [[1], [2]] and got["2"]["vector"] == [1]
    assert got["3"]["sparse"]["kw"]["indices"] == [5] and got["3"]["vector"] == [7] and got["4"]["vector"] is None


def test_html_text(spark):
    html = "<html><style>p{}</style><p>A &amp; B</p><script>x</script><p>C<br>D</p></html>"
    assert spark.range(1).select(ingest.html_text(F.lit(html)).alias("t")).first()["t"] == "A & B\nC\nD"


def test_id_numbers(spark):
    ids = spark.createDataFrame([("7",), ("x",), (str(2**63),)], "id string")
    assert [r[0] for r in ids.select(points.id_number(F.col("id"))).collect()] == [7, None, -(2**63)]
