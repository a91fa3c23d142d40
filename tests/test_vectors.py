import math

import pytest
from pyspark.sql import functions as F

from pointsmith.functions import vecmath as vm


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*xs):
    return F.lit([float(x) for x in xs]).cast("array<float>")


def rows(*rs):
    return F.lit([[float(x) for x in r] for r in rs])


def test_scalars(spark):
    assert value(spark, vm.cosine(vec(1, 0), vec(1, 0))) == pytest.approx(1)
    assert value(spark, vm.cosine(vec(1, 0), vec(0, 1))) == pytest.approx(0)
    assert value(spark, vm.l2_distance(vec(0, 0), vec(3, 4))) == pytest.approx(5)
    assert value(spark, vm.dot(vec(1, 2), vec(3, 4))) == 11
    assert value(spark, vm.norm(vec(3, 4))) == 5


def test_mismatch_and_zero(spark):
    assert value(spark, vm.dot(vec(1), vec(1, 2))) == 0
    assert value(spark, vm.l2_distance(vec(1), vec(1, 2))) == math.inf
    assert value(spark, vm.cosine(vec(0, 0), vec(1, 2))) == 0
    assert value(spark, vm.normalize(vec(0, 0))) == [0, 0]
    assert value(spark, vm.normalize(vec(3, 4))) == pytest.approx([0.6, 0.8])


def test_max_sim(spark):
    one = rows([1, 0], [0, 1])
    assert value(spark, vm.max_sim(one, one)) == pytest.approx(2)
    assert value(spark, vm.max_sim(rows([1, 0]), rows([1, 0], [0, 1]))) == pytest.approx(1)
    assert value(spark, vm.max_sim_cosine(rows([2, 0]), rows([5, 0], [0, 0]))) == pytest.approx(1)
    assert value(spark, vm.max_sim_l2(rows([0, 0]), rows([3, 4], [0, 1]))) == pytest.approx(-1)
    assert value(spark, vm.max_sim(rows([1, 0]), rows([1, 0, 0]))) == 0
    assert value(spark, vm.max_sim_l2(rows([1, 0]), rows([1, 0, 0]))) == -math.inf


def test_multivector_forms(spark):
    assert value(spark, vm.is_multivector(rows([1, 2], [3, 4])))
    assert not value(spark, vm.is_multivector(rows([1, 2], [3])))
    assert value(spark, vm.first(rows([1, 2], [3, 4]))) == [1, 2]


def test_sparse_dot(spark):
    doc = F.struct(F.lit([1, 7, 1]).cast("array<bigint>").alias("indices"), F.lit([2.0, 3.0, 4.0]).cast("array<float>").alias("values"))
    assert value(spark, vm.sparse_dot(doc, [(1, 1.0), (7, 0.5), (7, 0.5), (9, 1.0)])) == pytest.approx(4 + 3)
    assert value(spark, vm.sparse_dot(doc, [])) == 0


def test_mean(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "v array<float>")
    assert vm.vector_mean(df, "v").first()["mean"] == [2, 4]
