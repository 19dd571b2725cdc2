"""Closed-form results of the vector functions."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowlens.functions import cosine, cosine_or, dequantize, norm, quantize, quantize_scale, sif_weight, without_component
from sparrowlens.operators import model


def coded(spark, *rows):
    d = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "id int, v array<double>")
    q = model.quantize_rows(d, "id", "v").orderBy("id").collect()
    return [(r.scale, list(r.codes)) for r in q]


def test_quantize_closed_form(spark):
    a, b, zero, ties = coded(spark, [1, -2, 0.5, 0], [0.25, -0.5, 0.1, -0.1], [0, 0, 0], [127, 62.5, -62.5])
    assert a == (pytest.approx(2 / 127), [64, -127, 32, 0])
    assert b == (pytest.approx(0.5 / 127), [64, -127, 25, -25])
    assert zero == (0.0, [0, 0, 0])
    assert ties == (1.0, [127, 63, -63])


def test_dequantized_error_is_half_a_step(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    r = model.quantize_error(e, "vec_id", "v")
    assert r.where("max_error > scale / 2 * 1.0001").isEmpty()
    report = model.fidelity(r)
    model.assert_fidelity(report)
    assert report.first().min_cosine > 0.9999
    with pytest.raises(ValueError):
        model.assert_fidelity(report, 1.1)
    assert model.fidelity(r.limit(0)).first().mean_cosine == 0


@settings(deadline=None, max_examples=25, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=5))
def test_round_trip_within_a_step(spark, v):
    d = spark.createDataFrame([(v,)], "v array<double>").withColumn("s", quantize_scale(F.col("v")))
    r = d.withColumn("b", dequantize(quantize(F.col("v"), F.col("s")), F.col("s"))).first()
    assert all(abs(x - y) <= max(r.s / 2 * 1.0001, 1e-8) for x, y in zip(r.v, r.b))


def test_cosine_and_component(spark):
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0, 0.0])], "a array<double>, z array<double>, c array<double>")
    r = d.select(
        cosine(F.col("a"), F.col("a")).alias("self"),
        cosine(F.col("a"), F.col("z")).alias("zero"),
        cosine_or(F.col("a"), F.col("z"), 1.0).alias("one"),
        norm(without_component(F.col("a"), F.col("c"))).alias("rest"),
        cosine(F.col("a"), F.lit(None).cast("array<double>")).alias("null"),
    ).first()
    assert (r.self, r.zero, r.one, r.rest, r.null) == (1.0, 0.0, 1.0, 0.0, None)


def test_sif_weights(spark):
    d = spark.createDataFrame([("a", 0.001), ("b", 0.0), ("c", None), ("[UNK]", 0.5)], "t string, f double")
    w = [r[0] for r in d.select(sif_weight(F.col("t"), F.col("f"), F.col("t") == "[UNK]")).collect()]
    assert w[0] == 0.5 and w[3] == 0.0 and all(math.isclose(x, 0.001 / (0.001 + 1e-9)) for x in w[1:3])
