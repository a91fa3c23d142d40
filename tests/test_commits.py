"""Catalog and stream commits that stop half way, batches, kernels, tools, and the forms added to search."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointsmith.functions import kernels, sqlfn, textfn
from pointsmith.functions import vecmath as vm
from pointsmith.operators import ann, paging, search, text_search
from pointsmith.operators.points import CollectionConfig, points_from_rpc
from pointsmith.operators.tools import filter_of
from pointsmith.session import cut, cut_mark, drop_cuts
from pointsmith.sources import ingest
from pointsmith.sources.catalog import Catalog, Conflict
from pointsmith.streaming import upserts


def _catalog(spark, tmp_path, dim=0):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.create_collection(CollectionConfig("c", dim))
    return catalog


def _rows(spark, *rows):
    return spark.createDataFrame([(str(i), v, None) for i, v in rows], "id string, price double, vector array<float>")


def test_a_writer_lost_before_its_state_leaves_the_old_one(spark, tmp_path, monkeypatch):
    catalog = _catalog(spark, tmp_path)
    catalog.write("c", _rows(spark, (1, 1.0)))
    monkeypatch.setattr(catalog, "_save", lambda meta: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        catalog.write("c", _rows(spark, (2, 2.0)))
    monkeypatch.undo()
    assert [r["id"] for r in Catalog(spark, catalog.root).points("c").collect()] == ["1"]


def test_a_writer_lost_with_its_claim_does_not_block(spark, tmp_path, monkeypatch):
    catalog = _catalog(spark, tmp_path)
    number = catalog._meta()["number"] + 1
    catalog.files._put(f"{catalog.root}/catalog/catalog-{number:012d}.json.claim", b"")
    monkeypatch.setattr("pointsmith.sources.catalog.CLAIM_SECONDS", 0.1)
    catalog.create_alias("a", "c")
    assert catalog.resolve("a") == "c"


def test_states_of_two_writers_conflict(spark, tmp_path):
    catalog = _catalog(spark, tmp_path)
    stale = catalog._meta()
    catalog.create_alias("a", "c")
    with pytest.raises(Conflict):
        catalog._save(stale)
    assert catalog.list_aliases() == {"a": "c"}
    # A write made from an older version of the collection is refused, too.
    catalog.write("c", _rows(spark, (1, 1.0)))
    with pytest.raises(Conflict):
        catalog.write("c", _rows(spark, (2, 2.0)), since=0)


def test_stream_batches_count_once(spark, tmp_path):
    catalog = _catalog(spark, tmp_path)
    catalog.upsert("c", _rows(spark, (1, 1.0)), batch=("s", 0))
    assert catalog.last_batch("c", "s") == 0 and catalog.last_batch("c", "other") == -1
    # Stopped after the commit, before Spark has noted the batch: the replay is passed over.
    source = tmp_path / "in"
    _rows(spark, (2, 2.0)).write.parquet(str(source))
    stream = spark.readStream.schema("id string, price double, vector array<float>").parquet(str(source))
    checkpoint = str(tmp_path / "checkpoint")
    catalog.upsert("c", _rows(spark, (2, 2.0)), batch=(checkpoint, 0))
    upserts.stream_upserts(stream, catalog, "c", checkpoint).awaitTermination()
    assert {r["id"]: r["version"] for r in catalog.points("c").collect()} == {"1": 0, "2": 0}


def test_dump_is_whole_until_the_next_is(spark, tmp_path, monkeypatch):
    catalog = _catalog(spark, tmp_path)
    catalog.write("c", _rows(spark, (1, 1.0)))
    path = str(tmp_path / "dump")
    catalog.save_all(path)
    catalog.write("c", _rows(spark, (2, 2.0)))
    monkeypatch.setattr(catalog.files, "write", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        catalog.save_all(path)
    monkeypatch.undo()
    catalog.load_all(path)
    assert [r["id"] for r in catalog.points("c").collect()] == ["1"]


def test_checksum_sees_repeated_rows(spark):
    one, three = _rows(spark, (1, 1.0)), _rows(spark, (1, 1.0), (2, 2.0), (2, 2.0))
    assert Catalog._checksum(one)["checksum"] != Catalog._checksum(three)["checksum"]


def test_cut_tables_can_be_dropped(spark):
    mark = cut_mark()
    a, b = cut(spark, spark.range(3)), cut(spark, spark.range(4))
    drop_cuts(spark, mark, but=mark + 1)
    assert b.count() == 4
    with pytest.raises(Exception):
        a.count()


@pytest.mark.parametrize("distance", ["Cosine", "Dot", "Euclidean"])
def test_kernels_agree_with_columns(spark, distance):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(40, [0.0] * 5), (41, [1.0, 2.0]), (42, None), (43, [])]
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    q = rng.normal(size=5).tolist()
    exact = [(r["id"], round(r["score"], 9)) for r in search.knn(points, q, 60, distance).collect()]
    asked = spark.createDataFrame([(7, q), (8, [1.0, 1.0]), (9, None)], "query_id int, q array<double>")
    got = search.knn_batch(points, asked, 60, distance).where("query_id = 7").orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 9)) for r in got] == exact
    first = search.knn_batch(points, asked, 3, distance).where("query_id = 8 and rank = 1").first()
    assert first["id"] == search.knn(points, [1.0, 1.0], 1, distance).first()["id"]


def test_batches_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(search, "BATCH_QUERIES", 10)
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "id long, vector array<double>")
    asked = points.select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    got = search.knn_batch(points, asked, 2)
    assert got.count() == 100 and got.where("rank = 1 and query_id = id").count() == 50


def test_ties_keep_the_smallest_ids(spark):
    points = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], "id long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(0, [2.0, 0.0])], "query_id int, q array<double>")
    assert sorted(r["id"] for r in search.knn_batch(points, asked, 4).collect()) == [0, 1, 2, 3]


def test_matrix_rows():
    x, fits = kernels.matrix(pa.array([[1.0, 2.0], None, [3.0], [4.0, None]]), 2)
    assert fits.tolist() == [True, False, False, False] and x[0].tolist() == [1.0, 2.0]


@pytest.mark.parametrize("n", [500, 3000])
def test_code_search_recall(spark, n):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, rng.normal(size=32).tolist()) for i in range(n)] + [(n, None)], "id long, vector array<double>")
    index = cut(spark, ann.with_codes(points, 32))
    asked = points.where("id % 100 = 0 and vector is not null").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    exact = {(r["query_id"], r["id"]) for r in search.knn_batch(points, asked).collect()}
    found = {(r["query_id"], r["id"]) for r in ann.search_codes(index, asked).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert ann.search_any(index, asked, exact_rows=100).count() == len(exact)


def test_postings_replace_and_delete(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma")], "id long, text string")
    index = text_search.postings(docs)
    index = text_search.replace_postings(index, spark.createDataFrame([(2, "delta delta")], "id long, text string"))
    assert {(r["term"], r["id"], r["tf"]) for r in index.collect()} == {("alpha", 1, 1), ("beta", 1, 2), ("delta", 2, 2)}
    left = text_search.delete_postings(index, spark.createDataFrame([(1,)], "id long"))
    assert {r["id"] for r in left.collect()} == {2} and text_search.postings_stats(left).first()["total"] == 2


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "alpha alpha gamma")], "id long, text string")
    assert text_search.bm25(docs, "").count() == 0 and text_search.bm25(docs, "... ?").count() == 0
    own = [r["id"] for r in text_search.bm25(docs, "beta").collect()]
    assert own == [1]
    assert [r["id"] for r in text_search.bm25(docs, "alpha", flt={"must": [{"has_id": [4]}]}).collect()] == [4]
    index = text_search.postings(docs)
    by_index = text_search.bm25_postings(index, text_search.corpus_stats(docs), "beta gamma")
    assert [(r["id"], round(r["score"], 9)) for r in by_index.collect()] == [(r["id"], round(r["score"], 9)) for r in text_search.bm25(docs, "beta gamma").collect()]


def test_chunks_follow_windows():
    assert textfn.chunks_of("x" * 1000) == ["x" * 1000] and textfn.chunks_of(" \n") == []
    assert [len(c) for c in textfn.chunks_of("x" * 1700)] == [1000, 900, 100]
    assert [len(c) for c in textfn.chunks_of("x" * 1600)] == [1000, 800]
    assert textfn.chunks_of("a" * 600 + "\n\n" + "b" * 600)[0] == "a" * 600


def test_tool_filters():
    assert filter_of({}) is None
    assert filter_of({"a": 1, "b": [1, 2], "c": {"gte": 3}}) == {"must": [{"key": "a", "match": {"value": 1}}, {"key": "b", "match": {"any": [1, 2]}}, {"key": "c", "range": {"gte": 3}}]}


def test_rpc_ids_and_named_vectors(spark):
    rows = points_from_rpc(spark, [{"id": "007", "vectors": {"a": [1.0], "b": [2.0]}}, {"id": "x7", "vectors": [3.0], "payload": {"k": 1}}]).collect()
    assert [(r["id"], r["id_num"], r["vector"]) for r in rows] == [("7", 7, [1.0]), ("x7", None, [3.0])]
    with pytest.raises(ValueError):
        points_from_rpc(spark, [{"id": 1}])


def test_sql_functions_agree_with_columns(spark):
    assert "vec_dot" in sqlfn.register(spark)
    row = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) AS d, vec_dot(array(1D), array(3D, 4D)) AS none, vec_l2(array(0D, 0D), array(3D, 4D)) AS l2, vec_cosine(array(0D), array(1D)) AS zero, vec_normalize(array(3D, 4D)) AS u, vec_scale(array(1D), 2D) AS s, text_tokens('The c-at, a') AS t, text_contains('Abc', 'bc') AS c").first()
    assert (row["d"], row["none"], row["l2"], row["zero"], row["u"], row["s"], row["t"], row["c"]) == (11.0, 0.0, 5.0, 0.0, [0.6, 0.8], [2.0], ["the", "at"], True)
    assert spark.range(1).select(vm.dot(F.lit([1.0, 2.0]), F.lit([3.0, 4.0]))).first()[0] == row["d"]


def test_documents_of_several_kinds(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("plain é", encoding="utf-8")
    (tmp_path / "b.html").write_text("<p>one</p><script>x</script>two")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Hello &amp; bye</w:t></w:p><w:p><w:t>end</w:t></w:p>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF some")
    found = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in ingest.read_documents(spark, str(tmp_path), lambda b: b[5:].decode()).collect()}
    assert found == {"a.txt": "plain é", "b.html": "one\ntwo", "c.docx": "Hello & bye\nend", "d.pdf": "some"}
    assert [r["text"] for r in ingest.read_documents(spark, str(tmp_path)).where("path like '%pdf'").collect()] == [None]


def test_envelope(spark):
    out = json.loads(ingest.to_envelope(spark.range(2).orderBy("id"), 0.5).first()[0])
    assert out["status"] == "ok" and sorted(r["id"] for r in out["result"]) == [0, 1]


def test_long_id_lists(spark):
    points = spark.range(2000).withColumnRenamed("id", "n").select(F.col("n").cast("string").alias("id"))
    asked = [str(i) for i in range(1500, 0, -1)]
    assert [r["id"] for r in paging.get_by_ids(points, asked).collect()] == asked
