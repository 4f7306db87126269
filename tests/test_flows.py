from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from probewise.functions import vectors as V
from probewise.operators import approximate as ann
from probewise.operators import retrieval as ret
from probewise.operators import similarity as sim
from probewise.plans.flows import ImageSearch, build_index, read_index, write_index

KEY = "0123456789abcdef" * 4
E = np.eye(4)


@pytest.fixture(scope="module")
def gallery(spark):
    rows = [(1, 1, E[0]), (2, 1, E[0] + 0.1 * E[1]), (3, 2, E[1]), (4, 3, E[2]), (5, 4, E[3])]
    emb = spark.createDataFrame(
        [(i, p, "custom", "m", 4, v.tolist(), datetime(2024, 1, i), True) for i, p, v in rows],
        "id long, person_id long, pipeline string, model string, dim int, v array<double>, created_at timestamp, is_active boolean",
    )
    people = spark.createDataFrame(
        [(1, "Ann", "active"), (2, "Bob", "active"), (3, "Eve", "deleted"), (4, "Scale Person 4", "active")],
        "id long, label string, status string",
    )
    return emb, people


FACE = "image_id long, face_index long, probe_id long, v array<double>"


def test_images_are_identified(spark, gallery):
    faces = spark.createDataFrame(
        [
            (1, 0, 10, E[0].tolist()), (1, 1, 11, (0.6 * E[0] + 0.8 * E[3]).tolist()),  # the same identity twice
            (2, 0, 20, E[1].tolist()), (3, 0, 30, E[2].tolist()), (4, 0, 40, E[3].tolist()),
            (5, 0, 50, (E[0] + E[1]).tolist()),  # between two subjects
        ],
        FACE,
    )
    found = ImageSearch(faces, *gallery, "custom", 0.3, 3)
    assert sorted((r["image_id"], r["face_index"], r["label"]) for r in found.results.collect()) == [
        (1, 0, "Ann"), (2, 0, "Bob"), (5, 0, "Ann"), (5, 0, "Bob"),
    ]
    summary = {r["image_id"]: (r["faces_processed"], r["matched_faces"], r["decision"]) for r in found.summary.collect()}
    assert summary == {1: (2, 1, "match"), 2: (1, 1, "match"), 3: (1, 0, "unknown"), 4: (1, 0, "unknown"), 5: (1, 1, "match")}


def test_no_faces_and_no_gallery(spark, gallery):
    emb, people = gallery
    faces = spark.createDataFrame([(1, 0, 10, E[0].tolist())], FACE)
    empty = ImageSearch(faces, emb.limit(0), people, "custom", 0.3, 3).summary.first()
    assert (empty["decision"], empty["best_score"], empty["search_mode"]) == ("unknown", None, "fast")
    assert ImageSearch(faces.limit(0), emb, people, "custom", 0.3, 3).summary.count() == 0


def test_index_from_stored_payloads(spark, gallery, tmp_path):
    emb, people = gallery
    raw = V.encode_vector(F.col("v").cast("array<float>"))
    cut = F.when(F.col("id") == 3, F.substring("raw", 1, 3)).otherwise(F.col("raw"))
    stored = emb.withColumn("raw", raw).withColumn("vector", F.when(F.col("id") == 1, V.encrypt_payload("raw", KEY)).otherwise(cut))
    index = build_index(stored.drop("v", "raw"), people, "custom", "m", 4, 2, KEY)
    assert sorted(r["id"] for r in index.assigned.collect()) == [1, 2, 5]
    write_index(index, str(tmp_path / "index"))
    again = read_index(spark, str(tmp_path / "index"))
    probes = spark.createDataFrame([(1, E[0].tolist())], "probe_id long, v array<float>")
    rows = ann.ivf_search(probes, again, 2, nprobe=9).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in rows] == [(1, 1.0), (2, 0.995037)]


def test_failed_configurations_stay_in_the_grid(spark, gallery):
    emb, _ = gallery
    g = sim.as_gallery(emb, "v", "id")
    p = sim.as_probes(emb, "v", "id")
    exact = sim.topk_exact(p, g, 2)
    configs = {
        "flat": lambda: sim.topk_blocked(p, g, 2),
        "codes": lambda: ann.pq_search(p, ann.ivf_build(g, 2), ann.pq_train(g, 3, 1), 2),
    }
    rows = {(r["config"], r["k"]): (r["status"], r["overlap"], r["notes"]) for r in ret.benchmark_grid(exact, configs, (1, 2), {"flat": "exact"}).collect()}
    assert rows[("flat", 1)] == ("ok", 1.0, "exact") and rows[("flat", 2)] == ("ok", 1.0, "exact")
    assert rows[("codes", 1)] == ("failed", None, "")
