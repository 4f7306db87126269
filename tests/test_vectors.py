import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from probewise.functions import vectors as V
from probewise.operators import vector_tables as vt
from probewise.operators.similarity import combine_views

KEY = "00112233445566778899aabbccddeeff" * 2


def table(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id long, v array<double>")


def test_bytes_round_trip(spark):
    df = table(spark, [[1.0, -2.5], [0.0, 3.25], None])
    coded = df.select("id", V.encode_vector("v").alias("raw"))
    rows = {r["id"]: r for r in coded.select("*", V.decode_vector("raw", 2).alias("w")).collect()}
    assert bytes(rows[0]["raw"]) == np.array([1.0, -2.5], "<f4").tobytes()
    assert rows[1]["w"] == [0.0, 3.25] and rows[2]["w"] is None
    assert all(r[0] is None for r in coded.select(V.decode_vector("raw", 3)).collect())


def test_bytes_of_any_batch(spark):
    none = spark.createDataFrame([(None,), (None,)], "v array<float>").coalesce(1)
    assert none.select(V.decode_vector(V.encode_vector("v"), 2).alias("w")).collect() == [(None,), (None,)]
    rows = [(None,), ([],), ([1.0, 2.0, 3.0],), (None,), ([4.0],), ([5.0, float("nan")],)]
    mixed = spark.createDataFrame(rows, "v array<float>").coalesce(1).select("v", V.encode_vector("v").alias("raw"))
    expected = [None if v is None else np.array(v, "<f4").tobytes() for (v,) in rows]
    assert [None if r["raw"] is None else bytes(r["raw"]) for r in mixed.collect()] == expected
    assert [r[0] for r in mixed.select(V.decode_vector("raw", 1)).collect()] == [None, None, None, None, [4.0], None]
    assert [r[0] for r in mixed.select(V.decode_vector("raw", 0)).collect()] == [None, [], None, None, None, None]


def test_payload_encryption(spark):
    df = spark.createDataFrame([(b"plain bytes",), (b"ENC1" + bytes(48),)], "p binary")
    sealed = df.select("p", V.encrypt_payload("p", KEY).alias("e")).first()
    assert bytes(sealed["e"]).startswith(b"ENC1") and len(sealed["e"]) == 4 + 12 + 11 + 16
    opened = df.select(V.decrypt_payload("p", KEY)).collect()
    assert bytes(opened[0][0]) == b"plain bytes" and opened[1][0] is None
    again = df.limit(1).select(V.encrypt_payload("p", KEY).alias("e"))
    assert bytes(again.select(V.decrypt_payload("e", KEY)).first()[0]) == b"plain bytes"
    assert again.select(V.decrypt_payload("e", KEY, "other")).first()[0] is None


def test_nonces_differ(spark):
    sealed = spark.range(50).select(V.encrypt_payload(F.lit(b"x"), KEY).alias("e"))
    assert sealed.distinct().count() == 50


def test_normalise(spark):
    df = table(spark, [[3.0, 4.0], [0.0, 0.0]])
    kept = [r[0] for r in df.select(V.l2_normalize("v", "keep")).collect()]
    assert kept == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(V.l2_normalize("v")).collect()[1][0] is None


def test_products(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, -1.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    cos = [r[0] for r in df.select(V.cosine("a", "b")).collect()]
    assert cos[0] == pytest.approx(0.0) and cos[1] is None and cos[2] is None
    first = df.limit(1)
    assert first.select(V.l2_distance("a", "b")).first()[0] == pytest.approx(np.sqrt(10))
    assert first.select(V.max_abs_difference("a", "b")).first()[0] == 3.0


def test_validation_reasons(spark):
    rows = [[1.0, 0.0], [1.0], [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0], None]
    found = [r["reason"] for r in vt.validate_vectors(table(spark, rows), 2).orderBy("id").collect()]
    assert found == ["ok", "dim_mismatch", "non_finite", "non_finite", "zero_norm", "undecodable"]
    assert vt.valid_rows(vt.validate_vectors(table(spark, rows), 2)).count() == 1


def test_uuid5(spark):
    parts = [("a", 1), ("käse", 22), ("", 0)] + [(f"n{i}", i) for i in range(40)]
    df = spark.createDataFrame(parts, "name string, n int")
    for row in df.select("name", "n", V.uuid5(F.lit("p"), "name", "n").alias("u")).collect():
        assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"p:{row['name']}:{row['n']}"))


def test_combined_views_are_unit_sums(spark):
    df = spark.createDataFrame([("a", [2.0, 0.0]), ("a", [0.0, 5.0]), ("b", [0.0, -3.0])], "k string, v array<double>")
    found = {r["k"]: r["v"] for r in combine_views(df, "k", "v").collect()}
    assert found["a"] == pytest.approx([np.sqrt(0.5)] * 2) and found["b"] == [0.0, -1.0]


def test_combined_views_over_many_batches(spark):
    rng = np.random.default_rng(5)
    # one key has half of the rows
    rows = [(int(rng.choice([0, 0, 0, 1, 2, 3])), rng.normal(size=3).tolist()) for _ in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "k long, v array<double>").repartition(5)
        found = {r["k"]: r["v"] for r in combine_views(df, "k", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(found) == {0, 1, 2, 3}
    for k, v in found.items():
        total = sum(np.array(x) / np.linalg.norm(x) for key, x in rows if key == k)
        assert v == pytest.approx(total / np.linalg.norm(total))


def test_parity_and_agreement(spark):
    a, b = table(spark, [[1.0, 0.0], [0.0, 1.0]]), table(spark, [[1.0, 0.00000001], [0.6, 0.8]])
    rows = vt.parity_check(a, b, "id", 2).orderBy("id").collect()
    assert [r["passed"] for r in rows] == [True, False]
    teacher = b.withColumn("status", F.when(F.col("id") == 0, "ok").otherwise("no_face"))
    row = vt.agreement_loss(a, teacher, "id").first()
    assert (row["pairs"], row["loss"]) == (1, 0.0)


@pytest.mark.parametrize("kind, params, size", [("flat", {}, 3 * 512 * 4), ("hnsw", {"m": 32}, 3 * 512 * 4 + 3 * 512), ("ivfpq", {"m": 32, "nbits": 8}, 96)])
def test_memory_estimate(spark, kind, params, size):
    df = spark.range(3).select(F.lit("c").alias("pipeline"), F.lit("m").alias("model"), F.lit(512).alias("dim"))
    assert vt.memory_estimate(df, kind, params).first()["memory_bytes"] == size
