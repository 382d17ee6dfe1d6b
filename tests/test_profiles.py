"""Profile scores on a small hierarchy, worked out by hand."""

from ontoweave.operators import ontology, profiles


def test_scores(spark):
    is_a = spark.createDataFrame([("eye", "all"), ("lens", "eye"), ("iris", "eye"), ("bone", "all"), ("spine", "bone")], "child string, parent string")
    shut = ontology.closure(is_a)
    weights = spark.createDataFrame([("all", 0.0), ("eye", 0.4), ("bone", 0.3), ("lens", 1.0), ("iris", 1.0), ("spine", 1.0)], "term string, specificity double")
    features = spark.createDataFrame([
        ("c", 1, "lens", False), ("c", 1, "lens", False), ("c", 1, "spine", False), ("c", 2, "eye", False), ("c", 2, "bone", True), ("c", 3, "iris", False), ("c", 3, "spine", True), ("c", 4, "spine", True), ("c", 4, None, False),
        ("c", 5, "eye", False), ("other", 9, "lens", False)], "cohort string, patient int, term string, excluded boolean")
    profile = spark.createDataFrame([("c", "lens", 0.9), ("c", "spine", 0.9), ("c", "eye", None), ("c", "iris", 0.1), ("none", "eye", 0.9)], "cohort string, term string, freq double")
    got = {r.cohort: r.asDict() for r in profiles.score_profiles(profile.where("term <> 'iris' or cohort <> 'c'"), features, shut, weights).collect()}
    # Observed: lens 1, spine 1, eye 2, iris 1; iris is met by the broader eye alone. Of two patients and a quarter of five: eye.
    # Spine: one has it, three lack it (one by bone); lens and eye are had and not lacked.
    assert got["c"] == {"cohort": "c", "patients": 5, "terms": 3, "recall": 0.8, "lenient": 1.0, "common_recall": 1.0, "supported": 1.0, "contradicted": 1}
    assert got["none"] == {"cohort": "none", "patients": 0, "terms": 1, "recall": 0.0, "lenient": 0.0, "common_recall": None, "supported": None, "contradicted": 0}
    assert profiles.score_profiles(profile.limit(0), features, shut, weights).count() == 0
