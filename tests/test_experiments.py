from functools import partial

import pytest

from coldgraph.plans import experiments
from tests.conftest import rows


def test_sweep_shows_the_spectral_map_ahead(spark, planted):
    nodes, edges = planted
    shares = (0.1, 0.2, 0.5)
    got = experiments.cold_sweep(nodes, edges, shares, ["features_vote", "spectral_vote"], "planted").collect()
    assert len(got) == 6 and list(got[0].asDict()) == list(experiments.RESULT_COLUMNS)
    mean = lambda model: sum(r["value"] for r in got if r["model"] == model) / len(shares)
    assert mean("spectral_vote") > mean("features_vote") > 0.1


@pytest.mark.parametrize("model", ["feature_classifier", "sage_classifier", "spectral_classifier"])
def test_trained_models_run_on_cold_rows(planted, model):
    nodes, edges = planted
    row = experiments.cold_sweep(nodes, edges, (0.2,), [model]).first()
    assert row["model"] == model and 0.1 < row["value"] <= 1.0


def test_sweep_needs_something_to_do(planted):
    with pytest.raises(ValueError):
        experiments.cold_sweep(*planted, ())


def test_grid_and_sharpness(spark):
    results = spark.createDataFrame(
        [("a", "t", "m1", 0.1, "acc", 0.9), ("a", "t", "m2", 0.1, "acc", 0.7), ("b", "t", "m2", 0.1, "acc", 0.6),
         ("a", "t", "m1", 0.5, "acc", 0.4), ("a", "t", "m2", 0.5, "acc", 0.6)],
        "dataset string, task string, model string, cold_share double, metric string, value double")
    grid = experiments.results_grid(results, ["a", "b"])
    got = {(r["cold_share"], r["model"]): (r["a"], r["a_best"], r["b"], r["b_best"]) for r in grid.collect()}
    assert got == {
        (0.1, "m1"): (0.9, True, None, False), (0.1, "m2"): (0.7, False, 0.6, True),
        (0.5, "m1"): (0.4, False, None, False), (0.5, "m2"): (0.6, True, None, False)}
    drops = rows(experiments.sharpness(results), "dataset", "model", "drop")
    assert drops == [("a", "m1", 0.5), ("a", "m2", 0.1), ("b", "m2", 0.0)]


def test_sweep_searches_once_for_all_shares_and_metrics(planted, monkeypatch):
    nodes, edges = planted
    shares = (0.5, 0.05, 0.2)
    models = {f"{m}-{k}": partial(experiments.features_vote, k=k, metric=m) for m, k in (("euclidean", 10), ("cosine", 10), ("cosine", 4))}
    alone = {name: lambda split, run=run: run(split) for name, run in models.items()}
    want = rows(experiments.cold_sweep(nodes, edges, shares, alone))
    searches = []
    nested = experiments.knn_nested
    monkeypatch.setattr(experiments, "knn", None)
    monkeypatch.setattr(experiments, "knn_nested", lambda *a: searches.append(a[2:]) or nested(*a))
    assert rows(experiments.cold_sweep(nodes, edges, shares, models)) == want and len(want) == 9
    assert searches == [(10, ["cosine", "euclidean"])]
