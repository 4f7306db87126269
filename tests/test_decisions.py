import pytest
from pyspark.sql import functions as F

from probewise.functions import labels
from probewise.operators import decisions as dec


@pytest.mark.parametrize(
    "space, multi, score, support, accepted",
    [
        ("custom", False, 0.36, 0, True), ("custom", False, 0.35, 1, False), ("custom", False, 0.32, 2, True),
        ("custom", False, 0.30, 3, False), ("custom", False, 0.30, 4, True),
        ("custom", True, 0.36, 9, True), ("custom", True, 0.34, 1, False), ("custom", True, 0.38, 0, True),
        ("pretrained", False, 0.54, 0, True), ("pretrained", False, 0.46, 2, True), ("pretrained", False, 0.45, 2, False),
        ("pretrained", False, 0.40, 3, True), ("pretrained", True, 0.54, 1, False), ("pretrained", True, 0.50, 2, True),
        ("pretrained", True, 0.46, 3, True), ("pretrained", True, 0.56, 0, True), ("pretrained", False, 0.39, 9, False),
    ],
)
def test_accept_steps(spark, space, multi, score, support, accepted):
    threshold = 0.2 if space == "custom" else 0.4
    args = [F.lit(x) for x in (space, score, support, threshold, "Ann", multi)]
    assert spark.range(1).select(dec.supported(*args)).first()[0] is accepted


def test_scale_labels_and_low_scores_are_refused(spark):
    def verdict(score, label):
        return spark.range(1).select(
            dec.supported(F.lit("custom"), F.lit(score), F.lit(9), F.lit(0.5), F.lit(label), F.lit(False))
        ).first()[0]

    assert verdict(0.6, "Ann") and not verdict(0.49, "Ann") and not verdict(0.6, "Dataset Identity 4")


@pytest.mark.parametrize(
    "space, multi, best, second, ambiguous",
    [
        ("custom", False, (0.33, 3), (0.29, 1), True), ("custom", False, (0.35, 3), (0.34, 1), False),
        ("custom", False, (0.35, 1), (0.32, 1), True), ("custom", False, (0.36, 1), (0.32, 2), False),
        ("custom", True, (0.37, 5), (0.30, 1), True), ("custom", True, (0.40, 1), (0.35, 1), True),
        ("pretrained", False, (0.49, 9), (0.44, 0), True), ("pretrained", False, (0.50, 0), (0.49, 9), False),
        ("pretrained", True, (0.55, 9), (0.49, 0), True), ("pretrained", True, (0.55, 9), (0.48, 0), False),
        ("custom", False, (0.31, 4), None, False),
    ],
)
def test_ambiguity(spark, space, multi, best, second, ambiguous):
    rows = [(1, space, multi, 10, *best)] + ([(1, space, multi, 11, *second)] if second else [])
    df = spark.createDataFrame(rows, "probe_id long, pipeline string, multi boolean, person_id long, score double, support_count long")
    assert dec.reject_ambiguous(df).count() == (0 if ambiguous else len(rows))


SCORED = "image_id long, face_index long, probe_id long, person_id long, label string, pipeline string, threshold double, id long, score double"


def test_best_and_support(spark):
    rows = [(1, 0, 1, 5, "A", "custom", 0.3, i, s) for i, s in ((1, 0.4), (2, 0.4), (3, 0.24), (4, 0.23))]
    row = dec.aggregate_identities(spark.createDataFrame(rows, SCORED)).first()
    assert (row["score"], row["embedding_id"], row["support_count"]) == (0.4, 1, 3)
    other = spark.createDataFrame([(*r[:5], "pretrained", *r[6:]) for r in rows], SCORED)
    assert dec.aggregate_identities(other).first()["support_count"] == 2


def test_one_identity_on_two_faces_stays_once(spark):
    schema = "image_id long, face_index long, person_id long, label string, score double, support_count long, rank int"
    rows = [
        (1, 0, 5, " Ann ", 0.9, 1, 1), (1, 1, 6, "ann", 0.8, 9, 1), (1, 1, 7, None, 0.7, 1, 2), (1, 2, 7, "", 0.7, 2, 1),
        (2, 0, 5, "Ann", 0.1, 1, 1), (1, 3, 8, "Eve", 0.5, 1, 1), (1, 2, 9, "eve", 0.5, 1, 2),
    ]
    kept = dec.dedup_identities(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["image_id"], r["face_index"], r["person_id"]) for r in kept) == [(1, 0, 5), (1, 2, 7), (1, 2, 9), (2, 0, 5)]


def test_summary(spark):
    probes = spark.createDataFrame(
        [(1, 0, 0.9, "fast", 5, None), (1, 1, 0.2, "safe_fallback", 9, "below_threshold"), (2, 0, None, "fast", 5, None),
         (3, 0, 0.1, "safe_fallback", 9, "near_threshold"), (3, 1, 0.1, "safe_fallback", 9, "below_threshold")],
        "image_id long, face_index long, best_score double, search_mode string, candidate_k int, fallback_reason string",
    )
    results = spark.createDataFrame([(1, 0, 0.8), (1, 0, 0.7)], "image_id long, face_index long, score double")
    rows = {r["image_id"]: tuple(r)[1:] for r in dec.summarize_search(results, probes).collect()}
    assert rows == {
        1: (2, 1, "match", 0.8, "mixed", 9, "below_threshold"),
        2: (1, 0, "unknown", None, "fast", 5, None),
        3: (2, 0, "unknown", 0.1, "safe_fallback", 9, "below_threshold, near_threshold"),
    }


def test_bands(spark):
    results = spark.createDataFrame(
        [(1, 0, 1, "A", 0.5, 0.4), (1, 0, 2, "B", 0.3, 0.4), (1, 1, 1, "A", 0.28, 0.4), (1, 2, 1, "A", 0.1, 0.4)],
        "image_id long, face_index long, person_id long, label string, score double, threshold double",
    )
    faces = spark.createDataFrame([(1, i) for i in range(4)], "image_id long, face_index long")
    rows = {r["face_index"]: (r["label"], r["quality"]) for r in dec.annotate_detections(results, faces).collect()}
    assert rows == {0: ("A", "match"), 1: ("A", "weak"), 2: ("A", "unknown"), 3: ("No match", "unknown")}


def test_threshold_choice(spark):
    df = spark.createDataFrame([("custom", True), ("custom", False), ("pretrained", False), ("x", True)], "p string, live boolean")

    def values(**settings):
        return [r[0] for r in df.select(labels.threshold_for("p", "live", settings)).collect()]

    assert values(custom_live=0.1, custom=0.2, pretrained=0.3, default=0.5) == [0.1, 0.2, 0.3, 0.5]
    assert values(custom=0.2) == [0.2, 0.2, 0.4, 0.4]


def test_label_helpers(spark):
    df = spark.createDataFrame([("AC_Ann_Lee", 1), ("Scale Person 4", 2), ("scale person 4", 3), ("a#scale", 4), (None, 5)], "label string, id long")
    rows = df.select(labels.clean_label("label"), labels.is_scale_label("label"), labels.identity_key("label", "id")).collect()
    assert [r[0] for r in rows] == ["Ann Lee", "Scale Person 4", "scale person 4", "a#scale", None]
    assert [r[1] for r in rows] == [False, True, False, True, False]
    assert rows[0][2] == "label:ac_ann_lee" and rows[4][2] == "person:5"


def test_subject_search(spark):
    one = "0f8fad5b-d9cb-469f-a165-70867728950e"
    df = spark.createDataFrame([(one, "50%_off"), ("7c9e6679-7425-40de-944b-e07fc1f90ae7", None)], "id string, label string")

    def found(q):
        return df.where(labels.matches_query("label", "id", q)).count()

    assert [found(q) for q in ("%_O", "0%o", one.replace("-", "").upper(), " ", None, "x")] == [1, 0, 1, 2, 2, 0]


@pytest.mark.parametrize(
    "path, identity",
    [("/d/a/x/1.jpg", "x"), ("/d/a/1.jpg", "a"), ("/d/a/train/bob/1.jpg", "bob"), ("/d/a/train/1.jpg", "train"), ("/e/q/1.jpg", "q"), ("/d/b/c/e/2.jpg", "b")],
)
def test_identity_from_path(spark, path, identity):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(labels.identity_from_path("path", ["/d/a", "/d"])).first()[0] == identity
