import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from pyspark.ml.functions import vector_to_array
from tillwatch.operators import ensembles, learning, metrics
from tillwatch.operators.learning import ModelConfig
from tillwatch.operators.quantiles import exact_quantiles
from tillwatch.plans import scoring, training
from tillwatch.plans.features import fraud_features
from tillwatch.session import work_dir
from tillwatch.sources.fixtures import accounts, tx_events

SMALL = ModelConfig(forest_trees=5, forest_depth=4, logistic_iterations=20)


@pytest.fixture(scope="module")
def features(spark):
    return training.materialise(fraud_features(tx_events(spark, TINY), accounts(spark, TINY)), "f")


def curve(pairs):
    """(tp, fp) at every distinct score, by definition."""
    return {
        s: (sum(1 for y, t in pairs if t >= s and y), sum(1 for y, t in pairs if t >= s and not y))
        for s in {t for _, t in pairs}
    }


def test_curves_equal_definition(spark):
    rng = random.Random(4)
    grid = [0.0, 1.0, 1e-9, 1 - 1e-9, 0.5] + [rng.random() for _ in range(40)]
    pairs = [(rng.randrange(2), rng.choice(grid)) for _ in range(300)]
    points = metrics.score_points(spark.createDataFrame(pairs, "label int, score double")).collect()
    want = curve(pairs)
    assert {r.threshold: (r.tp, r.fp) for r in points} == want
    order = sorted(want)
    assert {r.threshold: r.scores - r["rank"] for r in points} == {s: i for i, s in enumerate(order)}


def test_ranking_scores_by_pairs(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(2), rng.randrange(12) / 11) for _ in range(200)]
    df = spark.createDataFrame(pairs, "label int, score double")
    got = metrics.ranking_scores(metrics.score_points(df)).first()
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert got.roc_auc == pytest.approx(wins / (len(pos) * len(neg)))
    before, ap = 0, 0.0
    for s, (tp, fp) in sorted(curve(pairs).items(), reverse=True):
        ap += (tp - before) / len(pos) * tp / (tp + fp)
        before = tp
    assert got.pr_auc == pytest.approx(ap)


def test_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, g int")
    counts = metrics.confusion_counts(df, F.col("y"), F.col("g"))
    rows = {r["class"]: r for r in metrics.classification_report(counts).collect()}
    assert rows["1"].precision == 0.0 and rows["1"].recall == 0.0
    assert rows["accuracy"].precision == 0.5


def test_split_is_exact_and_stable(spark, features):
    marked = learning.stratified_split(features, "is_fraud", "transaction_id")
    for row in marked.groupBy("is_fraud").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("in_test").alias("t")
    ).collect():
        assert row.t == int(row.n * 0.2 + 0.5)
    again = learning.stratified_split(features.repartition(7), "is_fraud", "transaction_id")
    assert again.where("in_test").join(marked.where("in_test"), "transaction_id", "left_anti").count() == 0


def test_weights_sum_to_rows(features):
    weights = learning.class_weights(features, "is_fraud").collect()
    assert sum(r.n * r.weight for r in weights) == pytest.approx(sum(r.n for r in weights))


def test_zero_count_ratio_and_cap(spark):
    columns = ", ".join(f"{c} double" for c in learning.PROFILE)
    rows = [(1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 50.0, 9999.0, 0.0), (1.0, 1.0, 0.0, 0.0, 0.0, 2.0, 50.0, 3.0, 0.0)]
    df = spark.createDataFrame(rows, columns)
    assert learning.fit_cap(df) == 3.0
    out = learning.derived_features(df, 3.0).collect()
    assert [r.avg_amt_per_txn_last_1h for r in out] == [0.0, 25.0]
    assert [r.days_since_last_trans for r in out] == [3.0, 3.0]
    assert [r.is_new_account_no_history for r in out] == [1.0, 0.0]


def test_train_save_score(spark, features):
    trained = training.train(features, SMALL, ("logistic_regression", "random_forest"))
    assert {r.model for r in trained.scores.collect()} == set(trained.models)
    types = learning.fit_fraud_type(features, SMALL)
    path = work_dir(spark, "test-model")
    training.save_model(path, trained.best_model, types)
    model, loaded_types, about = training.load_model(path)
    assert about["columns"] == learning.PROFILE
    good, refused = scoring.score_valid(features, model, loaded_types)
    rows = good.collect()
    assert len(rows) + refused.count() == features.count()
    assert all(0 <= r.fraud_probability <= 1 for r in rows)
    assert all((r.fraud_type is not None) == r.is_fraud for r in rows)
    assert rows[0].status == "PREDICTION_COMPLETED"
    bare = scoring.score_batch(features, model).where(F.col("fraud_type").isNotNull())
    assert bare.count() == 0
    before = {r.transaction_id: r.score for r in training.score_rows(trained.best_model, features, "m").collect()}
    after = {r.transaction_id: r.score for r in training.score_rows(model, features, "m").collect()}
    assert before == after


def test_quantiles_equal_numpys(spark):
    import math

    import numpy as np

    rng = np.random.default_rng(4)
    columns = {
        "spread": rng.lognormal(0, 20, 400),
        "ties": rng.integers(0, 4, 400).astype(float),
        "one": np.full(400, -7.25),
        "wide": np.concatenate([[-1.7e308, 1.7e308, 5e-324], rng.standard_normal(397)]),
        "burst": np.concatenate([1e6 + rng.random(390) * 1e-6, rng.standard_normal(10)]),
    }
    rows = [tuple(float(v[i]) for v in columns.values()) + (bool(i % 3),) for i in range(400)]
    rows += [(None, math.nan, None, None, None, True), (1.0, None, None, 2.0, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", flag boolean")
    wanted = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]
    for bins, few in ((3, 1), (256, 30), (256, 10_000)):
        got = exact_quantiles(df, list(columns), wanted, "flag", bins, few)
        for flag in (0, 1):
            for i, c in enumerate(columns):
                values = sorted(r[i] for r in rows if r[5] is not None and int(r[5]) == flag and r[i] is not None and not math.isnan(r[i]))
                for p, v in zip(wanted, got[flag, c]):
                    at = p * (len(values) - 1)
                    low = values[math.floor(at)]
                    assert v == low + (values[math.ceil(at)] - low) * (at - math.floor(at))
        assert got[None, "spread"] == [1.0] * 7 and (None, "ties") not in got
    assert exact_quantiles(df.limit(0), ["ties"], wanted) == {}


def test_nodes_score_as_the_model_does(spark, features):
    small = ModelConfig(forest_trees=5, forest_depth=4, logistic_iterations=20, boost_iterations=5, boost_depth=3)
    trained = training.train(features, small)
    for name, score in (("random_forest", ensembles.forest_scores), ("gradient_boosting", ensembles.boosting_scores)):
        model = trained.models[name]
        path = work_dir(spark, "nodes")
        model.stages[-1].save(path)
        rows = model.transform(learning.as_reals(features)).select("transaction_id", vector_to_array("features").alias("features"), vector_to_array("probability")[1].alias("p"))
        again = score(rows.select("transaction_id", "features"), ensembles.node_table(spark, path), model.stages[-1].getMaxDepth(), "transaction_id")
        both = rows.join(again, "transaction_id").collect()
        assert len(both) == features.count() and max(abs(r.p - r.score) for r in both) < 1e-9


def test_model_queries_fit_the_full_sizes(monkeypatch, spark):
    from tests.conftest import TINY
    from tillwatch.catalog import learning as catalog

    used = []
    monkeypatch.setattr(catalog.training, "train", lambda rows, config: used.append(config))
    monkeypatch.setattr(catalog.learning, "fit_fraud_type", lambda rows, config: used.append(config))
    catalog._fitted.__wrapped__("test", TINY)
    assert used == [catalog.ModelConfig()] * 2


def test_a_model_query_fits_its_own_model_only(monkeypatch, spark):
    from tillwatch.catalog import learning as catalog

    fitted = []
    fit = learning.fit_ready
    monkeypatch.setattr(learning, "fit_ready", lambda ready, name, cfg: fitted.append(name) or fit(ready, name, SMALL))
    monkeypatch.setattr(learning, "fit_fraud_type", lambda rows, cfg: fitted.append("types"))
    catalog._trained.cache_clear()
    try:
        assert catalog.train_logreg(spark, TINY).count() == catalog.train_rf(spark, TINY).count() > 0
    finally:
        catalog._trained.cache_clear()
    assert fitted == ["logistic_regression", "random_forest"]


def test_candidates_are_fitted_at_the_same_time_on_rows_prepared_once(monkeypatch, features):
    import threading

    meeting, prepared = threading.Barrier(2, timeout=60), []
    ready = learning.ready_rows
    monkeypatch.setattr(learning, "ready_rows", lambda rows: prepared.append(1) or ready(rows))
    monkeypatch.setattr(learning, "fit_ready", lambda ready, name, cfg: meeting.wait() >= 0 and name)
    models = training.train(features, SMALL, ("logistic_regression", "random_forest")).models
    assert models == {n: n for n in ("logistic_regression", "random_forest")} and prepared == [1]


def test_parts_for_fits():
    assert [training.pass_partitions(n, 12) for n in (0, 10_000, 100_000, 480_000, 36e6)] == [1, 1, 4, 12, 36]


def test_a_walk_through_the_nodes_is_one_join_at_any_depth(spark):
    nodes = [(0, 2.0, 0, 1, 2, 1, 0.5, 0.0, [3.0, 1.0]), (0, 2.0, 1, -1, -1, -1, 0.0, -1.0, [3.0, 0.0]), (0, 2.0, 2, 3, 4, 0, 0.5, 0.0, [0.0, 1.0])]
    nodes += [(0, 2.0, 3, -1, -1, -1, 0.0, 5.0, [0.0, 1.0]), (0, 2.0, 4, -1, -1, -1, 0.0, 7.0, [1.0, 1.0]), (1, 0.5, 0, -1, -1, -1, 0.0, 9.0, [2.0, 2.0])]
    schema = "tree int, weight double, node int, left int, right int, feature int, threshold double, prediction double, stats array<double>"
    table = spark.createDataFrame(nodes[::-1], schema)
    rows = spark.createDataFrame([("a", [0.0, 0.5]), ("b", [0.5, 0.6]), ("c", [0.6, 0.6])], "k string, x array<double>")
    found = ensembles.leaves(rows, table, 12, "k", "x")
    got = {(r.k, r.tree): (r.weight, r.prediction, r.stats) for r in found.collect()}
    first = {"a": (2.0, -1.0, [3.0, 0.0]), "b": (2.0, 5.0, [0.0, 1.0]), "c": (2.0, 7.0, [1.0, 1.0])}
    assert got == {(k, 0): v for k, v in first.items()} | {(k, 1): (0.5, 9.0, [2.0, 2.0]) for k in "abc"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_cells_of_a_quantile_are_part_of_the_plan(spark):
    from tillwatch.operators import quantiles

    rows = spark.range(100).select(F.lit(None).cast("int").alias("__label"), F.lit("a").alias("__feature"), F.col("id").cast("double").alias("value"))
    inside, _ = quantiles._in_cells(rows, {(None, "a", 7): (5.0, 9.0, 2)})
    assert inside.count() == 5
    assert "LogicalRDD" not in inside._jdf.queryExecution().optimizedPlan().toString()  # a job with Python workers


def test_rows_for_fits_are_derived_once(monkeypatch, features):
    written = []
    write = learning.materialise
    monkeypatch.setattr(learning, "materialise", lambda df, name: written.append(name) or write(df, name))
    ready = learning.ready_rows(features)
    assert written == ["derived"] and all("/derived-" in f for f in ready.rows.inputFiles())
    by_stages = learning.as_reals(features)
    for stage in ready.stages:
        by_stages = stage.transform(by_stages)
    plain = lambda df: sorted(tuple(r.features.toArray()) for r in df.select("features").collect())
    assert plain(ready.rows) == plain(by_stages)


def test_model_queries_split_the_profile_once(monkeypatch, spark):
    from tillwatch.catalog import learning as catalog

    splits = []
    split = learning.stratified_split
    monkeypatch.setattr(learning, "stratified_split", lambda *args: splits.append(args[1]) or split(*args))
    catalog._trained.cache_clear()
    try:
        _, rows, test = catalog.candidates(spark, TINY)
        assert rows.count() == 1000 and 0 < test.count() < 1000
    finally:
        catalog._trained.cache_clear()
    assert splits == ["is_fraud"]


def test_a_fit_beside_others_takes_half_of_the_cores(spark):
    rows = spark.range(8, numPartitions=4).toDF("label")
    parts = lambda: learning.in_share(learning.Ready(rows, [], 200_000.0)).rdd.getNumPartitions()
    seen = []
    training.side_by_side(spark, [lambda: seen.append(parts()), lambda: seen.append(parts())])
    assert (seen, parts()) == ([2, 2], 4)


def test_scenario_types_follow_the_forest_in_its_share(monkeypatch, spark, features):
    from tillwatch.session import fit_cores

    order = []
    monkeypatch.setattr(learning, "fit_ready", lambda ready, name, cfg: order.append((name, fit_cores(spark))) or name)
    trained = training.train(features, SMALL, ("random_forest", "gradient_boosting"))
    trained.fit_with(lambda: order.append(("types", fit_cores(spark))))
    assert sorted(order) == [("gradient_boosting", 2), ("random_forest", 2), ("types", 2)]
    assert order.index(("random_forest", 2)) < order.index(("types", 2))


def test_small_parts_of_all_columns_are_sorted_in_one_pass(monkeypatch, spark):
    from tillwatch.operators import quantiles

    passes = []
    sort = quantiles._sorted
    monkeypatch.setattr(quantiles, "_sorted", lambda long, cells: passes.append(len(cells)) or sort(long, cells))
    spread = spark.range(1001).select(F.col("id").cast("double").alias("even"), F.exp(F.col("id") / 20).alias("tail"))
    got = exact_quantiles(spread, ["even", "tail"], [0.5], bins=4, few=260)
    assert got[None, "even"] == [500.0] and got[None, "tail"] == [spread.where("even = 500").first().tail]
    assert passes == [4]  # two ranks a column; the even column's part is small a round or more before the other's


def mixed_rows(spark, n=3000):
    """Columns of few values, so that the library and ours cut them alike; two weights."""
    from pyspark.ml.feature import VectorAssembler

    columns = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(5 + 6 * i)).cast("double").alias(f"c{i}") for i in range(4)]
    rows = spark.range(n, numPartitions=3).select("id", *columns)
    label = (F.col("c0") * F.col("c1") + F.col("c2") + F.pmod(F.xxhash64("id", F.lit(9)), F.lit(7)) > 14).cast("double")
    rows = rows.withColumn("label", label).withColumn("weight", F.when(F.col("label") == 1, 1.7).otherwise(0.6))
    return training.materialise(VectorAssembler(inputCols=["c0", "c1", "c2", "c3"], outputCol="features").transform(rows), "mixed")


def chances(model, rows):
    return {r.id: r.p for r in model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()}


def test_boosting_equals_the_librarys(spark):
    from pyspark.ml.classification import GBTClassifier
    from tillwatch.operators import trees

    rows = mixed_rows(spark)
    asked = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.08, weightCol="weight")
    ours, theirs = trees.fit_boosting(asked, rows), asked.fit(rows)
    got, want = chances(ours, rows), chances(theirs, rows)
    assert len(got) == 3000 and max(abs(got[i] - want[i]) for i in want) < 1e-9
    assert list(ours.featureImportances.toArray()) == pytest.approx(list(theirs.featureImportances.toArray()))
    assert (ours.getNumTrees, ours.treeWeights, ours.getMaxDepth()) == (12, theirs.treeWeights, 4)


def test_boosting_does_not_depend_on_the_parts_of_the_rows(spark):
    from tillwatch.operators import trees

    rows = mixed_rows(spark)
    nodes = [trees.boosted_trees(r, "label", 12, 0.08, 4)[0] for r in (rows, rows.repartition(5, "c3"))]
    for a, b in zip(*nodes):
        assert all((a[c] == b[c]).all() for c in ("left", "feature", "gain", "prediction", "count")) and a["thresholds"] == b["thresholds"]
        leaves = a["left"] < 0
        assert a["count"][leaves].sum() == a["count"][0] == 3000


def test_a_tree_of_the_forest_equals_the_librarys(spark):
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
    from tillwatch.operators import trees

    rows = mixed_rows(spark)
    want = DecisionTreeClassifier(maxDepth=6, weightCol="weight").fit(rows)
    nodes = trees.forest_trees(rows, "label", [0.6, 1.7], 1, 6, None, 1, bagged=False)
    asked = RandomForestClassifier(numTrees=1, maxDepth=6, weightCol="weight")
    got = trees._as_model(spark, RandomForestClassificationModel, asked, nodes, [1.0], 4, numClasses=2)
    assert got.totalNumNodes == want.numNodes
    assert chances(got, rows) == pytest.approx(chances(want, rows))


def test_a_forest_keeps_no_row_a_tree_and_grows_in_any_groups(monkeypatch, spark):
    from pyspark.ml.classification import RandomForestClassifier
    from tillwatch.operators import trees

    rows = mixed_rows(spark)
    asked = RandomForestClassifier(numTrees=20, maxDepth=6, weightCol="weight", seed=3)
    held = []
    collect = trees.RDD.collect
    monkeypatch.setattr(trees.RDD, "collect", lambda rdd: held.append(spark.sparkContext._jsc.getPersistentRDDs().size()) or collect(rdd))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    whole = trees.fit_forest(asked, rows)
    assert max(held) == before + 1 and spark.sparkContext._jsc.getPersistentRDDs().size() == before
    monkeypatch.setattr(trees, "SUMS_BYTES", 1)  # a tree a pass
    ours, theirs = chances(whole, rows), chances(asked.fit(rows), rows)
    assert chances(trees.fit_forest(asked, rows), rows) == ours
    labels = {r.id: r.label == 1 for r in rows.collect()}
    right = [sum((found[i] > 0.5) == labels[i] for i in labels) for found in (ours, theirs)]
    assert right[0] >= right[1] - 60


def test_cuts_take_even_shares_of_all_rows():
    import numpy as np
    from tillwatch.operators import trees

    rng = np.random.default_rng(1)
    parts = [np.concatenate([np.zeros(30_000), rng.lognormal(0, 3, 30_000)]) for _ in range(5)]
    held = [trees.merged(p, np.ones(len(p))) for p in parts]
    assert all(len(v) <= trees.SUMMARY and w.sum() == 60_000 for v, w in held)
    cuts = trees.cut_points(*trees.merged(*map(np.concatenate, zip(*held)), limit=10**6), 32)
    sizes = np.bincount(np.searchsorted(cuts, np.concatenate(parts)))
    assert len(cuts) == 31 and sizes[0] == 150_000 and abs(sizes[1:] - 150_000 / 31).max() < 600
    few = trees.cut_points(*trees.merged(np.array([3.0, 1.0, 3.0]), np.ones(3)), 32)
    assert few.tolist() == [2.0] and trees.cut_points(np.array([7.0]), np.ones(1), 32).tolist() == []


def test_scores_by_nodes_form_no_pairs_of_row_and_tree(spark):
    nodes = [(0, 2.0, 0, 1, 2, 1, 0.5, 0.0, [3.0, 1.0]), (0, 2.0, 1, -1, -1, -1, None, -1.0, [3.0, 0.0]), (0, 2.0, 2, -1, -1, -1, None, 5.0, [1.0, 1.0])]
    nodes += [(1, 0.5, 0, -1, -1, -1, None, 9.0, [1.0, 3.0])]
    schema = "tree int, weight double, node int, left int, right int, feature int, threshold double, prediction double, stats array<double>"
    table = spark.createDataFrame(nodes[::-1], schema)
    rows = spark.createDataFrame([("a", [0.0, 0.5]), ("b", [0.5, 0.6]), ("c", [9.0, 0.4])], "k string, x array<double>")
    forest, boosting = (f(rows, table, 3, "k", "x") for f in (ensembles.forest_scores, ensembles.boosting_scores))
    assert {r.k: r.score for r in forest.collect()} == {"a": 0.375, "b": 0.625, "c": 0.375}
    assert {r.k: r.score for r in boosting.collect()} == pytest.approx({k: 1 / (1 + 2.718281828459045 ** (-2 * m)) for k, m in (("a", 2.5), ("b", 14.5), ("c", 2.5))})
    plan = forest._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " not in plan and "Aggregate" not in plan
