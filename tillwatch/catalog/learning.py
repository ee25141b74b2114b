"""Model pipeline steps and evaluation tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession, functions as F

from ..operators import ensembles, learning, metrics
from ..operators.learning import ModelConfig
from ..plans import scoring, training
from ..schemas import DERIVED, FRAUD_TYPES
from ..session import work_dir
from ..sources.fixtures import TX_SQL, tx_events
from .features import PROFILE_SQL, profile, profile_out
from .registry import query

# The full sizes: every model query reports on the job as it would be run.
FULL = ModelConfig()

SCORED_SQL = f"""WITH {TX_SQL}, scored AS (SELECT id, CAST(is_fraud AS INTEGER) AS label,
  ((id * 7919) % 1000) / 1000.0 AS score FROM tx),
tally AS (SELECT score AS threshold, sum(label) AS pos, count(*) - sum(label) AS neg
  FROM scored GROUP BY score),
points AS (SELECT threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n, row_number() OVER (ORDER BY threshold) - 1 AS position,
    count(*) OVER () AS scores
  FROM tally WINDOW w AS (ORDER BY threshold DESC))"""


def scored_rows(spark, d):
    """A fixed score column, so that evaluation tables can be checked exactly."""
    return tx_events(spark, d).select(
        "id",
        F.col("is_fraud").cast("int").alias("label"),
        (((F.col("id") * 7919) % 1000) / 1000.0).alias("score"),
    )


def points(spark, d):
    return metrics.score_points(scored_rows(spark, d))


def rounded(df, places=6):
    return df.select(
        *[
            F.round(c, places).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


@query(
    "M1_label_normalise",
    f"""WITH {TX_SQL} SELECT id, CASE WHEN is_fraud THEN 1 WHEN amount >= 10 THEN 0 END AS label
FROM tx""",
)
def label_normalise(spark, d):
    # The label as different writers spell it; 'n/a' is not a label.
    text = (
        F.when(F.col("is_fraud") & (F.col("amount") > 100), "True")
        .when(F.col("is_fraud") & (F.col("amount") > 50), "1")
        .when(F.col("is_fraud"), "TRUE")
        .when(F.col("amount") > 50, "False")
        .when(F.col("amount") >= 10, "0")
        .otherwise("n/a")
    )
    return tx_events(spark, d).select("id", learning.normalise_label(text).alias("label"))


@query(
    "M2_drop_id_and_leak",
    PROFILE_SQL
    + """ SELECT round(trans_amount, 2) AS trans_amount, round(age_hours_open_acc, 4) AS age_hours_open_acc,
  receiver_txn_count_last_3d, unique_senders_last_3d, multi_same_amt_count_2d,
  sender_txn_count_last_1h, round(sender_volume_last_1h, 2) AS sender_volume_last_1h,
  round(days_since_last_trans, 4) AS days_since_last_trans, round(geo_speed_kmh, 4) AS geo_speed_kmh,
  is_fraud FROM profile""",
)
def drop_id_and_leak(spark, d):
    return learning.drop_id_and_leak(profile_out(profile(spark, d)))


@query(
    "M3_derived_features",
    PROFILE_SQL
    + """, cap AS (SELECT max(days_since_last_trans) AS cap FROM profile WHERE days_since_last_trans < 9999)
SELECT transaction_id,
  CASE WHEN days_since_last_trans >= 9999 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_new_account_no_history,
  round(CASE WHEN days_since_last_trans >= 9999 THEN (SELECT cap FROM cap)
    ELSE days_since_last_trans END, 6) AS days_since_last_trans,
  round(ln(1 + greatest(trans_amount, 0)), 6) AS trans_amount_log,
  round(ln(1 + greatest(sender_volume_last_1h, 0)), 6) AS sender_volume_last_1h_log,
  round(CASE WHEN sender_txn_count_last_1h > 0 THEN sender_volume_last_1h / sender_txn_count_last_1h
    ELSE 0.0 END, 6) AS avg_amt_per_txn_last_1h FROM profile""",
)
def derived_features(spark, d):
    rows = learning.as_reals(profile(spark, d))
    out = learning.derived_features(rows, learning.fit_cap(rows))
    return rounded(out.select("transaction_id", "days_since_last_trans", *DERIVED))


@query(
    "M4_stratified_split",
    f"""WITH {TX_SQL}, r AS (SELECT id, is_fraud,
    row_number() OVER (PARTITION BY is_fraud ORDER BY md5(CAST(id AS VARCHAR) || ':42')) AS place,
    count(*) OVER (PARTITION BY is_fraud) AS n FROM tx)
SELECT id, is_fraud, place <= floor(n * 0.2 + 0.5) AS in_test FROM r""",
)
def stratified_split(spark, d):
    rows = tx_events(spark, d).select("id", "is_fraud")
    return learning.stratified_split(rows, "is_fraud", "id")


# Test rows of a split by a column: the lowest draws of each class.
def _split_sql(rows: str, by: str) -> str:
    return f"""split AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(CAST(transaction_id AS VARCHAR) || ':42'))
    <= floor(count(*) OVER (PARTITION BY {by}) * 0.2 + 0.5) AS in_test FROM {rows})"""


SPLIT_SQL = f"""{PROFILE_SQL.replace("profile AS (", "profile AS MATERIALIZED (")}, {_split_sql("profile", "is_fraud")}"""
M5_SQL = SPLIT_SQL + """, cap AS (SELECT max(days_since_last_trans) AS cap FROM split WHERE days_since_last_trans < 9999 AND NOT in_test),
derived AS (SELECT * REPLACE (CASE WHEN days_since_last_trans >= 9999 THEN (SELECT cap FROM cap) ELSE days_since_last_trans END
    AS days_since_last_trans), days_since_last_trans >= 9999 AS new_account,
  ln(1 + greatest(trans_amount, 0)) AS trans_amount_log, ln(1 + greatest(sender_volume_last_1h, 0)) AS sender_volume_last_1h_log,
  CASE WHEN sender_txn_count_last_1h > 0 THEN sender_volume_last_1h / sender_txn_count_last_1h ELSE 0.0 END AS avg_amt_per_txn_last_1h
  FROM split), long AS (""" + " UNION ALL ".join(
    f"SELECT transaction_id, in_test, '{c}' AS feature, CAST({'new_account' if c == 'is_new_account_no_history' else c} AS DOUBLE) AS v FROM derived"
    for c in learning.MODEL_COLUMNS
) + """), medians AS (SELECT feature, quantile_cont(v, 0.5) AS med FROM long WHERE NOT in_test GROUP BY feature),
filled AS (SELECT transaction_id, in_test, feature, coalesce(v, med) AS v FROM long JOIN medians USING (feature)),
scale AS (SELECT feature, avg(v) AS mean, stddev_pop(v) AS spread FROM filled WHERE NOT in_test GROUP BY feature)
SELECT transaction_id, feature, round((v - mean) / CASE WHEN spread > 0 THEN spread ELSE 1 END, 6) + 0.0 AS scaled FROM filled JOIN scale USING (feature)"""


@query("M5_preprocess", M5_SQL)
def preprocess(spark, d):
    """Every profile row imputed and scaled with statistics of the training rows only."""
    features = training.materialise(learning.as_reals(profile(spark, d)), "features")
    train, _ = training.split(features, FULL)
    cap = learning.fit_cap(train)
    train = learning.derived_features(train, cap)
    fitted = Pipeline(stages=learning.preprocess_stages(learning.MODEL_COLUMNS, train)).fit(train)
    out = fitted.transform(learning.derived_features(features, cap))
    names = F.array(*[F.lit(c) for c in learning.MODEL_COLUMNS])
    cells = out.select("transaction_id", F.inline(F.arrays_zip(names.alias("feature"), vector_to_array("features").alias("scaled"))))
    return cells.withColumn("scaled", F.round("scaled", 6) + 0.0)


@query(
    "M6_class_weights",
    f"""WITH {TX_SQL}, c AS (SELECT fraud_type AS label, count(*) AS n FROM tx WHERE is_fraud GROUP BY 1)
SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""",
)
def class_weights(spark, d):
    return rounded(learning.class_weights(tx_events(spark, d).where("is_fraud"), "fraud_type"))


@lru_cache(maxsize=4)
def _trained(app_id: str, sf_dir: str):
    """The candidate models and the profile: one of each per session and data folder serves all queries."""
    spark = SparkSession.getActiveSession()
    features = training.materialise(profile(spark, sf_dir), "features")
    return training.train(features, FULL), features


@lru_cache(maxsize=4)
def _types(app_id: str, sf_dir: str):
    """The scenario classifier."""
    rows, _ = type_split(_trained(app_id, sf_dir)[1])
    return learning.fit_fraud_type(rows, FULL)


@lru_cache(maxsize=4)
def _fitted(app_id: str, sf_dir: str):
    trained, features = _trained(app_id, sf_dir)
    return trained, _types(app_id, sf_dir), features


def type_split(features):
    """Fraud rows split anew, in proportion to their types."""
    return training.split(features.where("is_fraud"), FULL, "fraud_type")


def candidates(spark, d):
    """The candidate models, the profile rows and the test rows; a model is fitted when it is asked for."""
    trained, features = _trained(spark.sparkContext.applicationId, d)
    return trained, features, trained.test_rows


def fitted(spark, d):
    """All candidates and the scenario classifier, fitted side by side; the profile rows and the test rows."""
    app_id = spark.sparkContext.applicationId
    trained = _trained(app_id, d)[0]
    trained.fit_with(lambda: _types(app_id, d))
    _, types, features = _fitted(app_id, d)
    return trained, types, features, trained.test_rows


def _scored_by(spark, d, name):
    return candidates(spark, d)[0].scored_by(name)


@query("M7_train_logreg")
def train_logreg(spark, d):
    return _scored_by(spark, d, "logistic_regression")


@query("M8_train_rf")
def train_rf(spark, d):
    return _scored_by(spark, d, "random_forest")


@query("M9_train_gbt")
def train_gbt(spark, d):
    return _scored_by(spark, d, "gradient_boosting")


@query("M10_train_fraud_type")
def train_fraud_type(spark, d):
    types = _types(spark.sparkContext.applicationId, d)
    _, test = type_split(candidates(spark, d)[1])
    guessed = types.transform(learning.as_reals(test))
    counts = metrics.confusion_counts(guessed, F.col("fraud_type"), F.col("predicted_fraud_type"))
    return metrics.classification_report(counts)


@query(
    "M10_type_supports",
    SPLIT_SQL.replace(_split_sql("profile", "is_fraud"), "frauds AS (SELECT * FROM profile WHERE is_fraud), " + _split_sql("frauds", "fraud_type"))
    + " SELECT fraud_type AS label, count(*) AS support FROM split WHERE in_test GROUP BY 1",
)
def type_supports(spark, d):
    """What the scenario classifier is judged on, by type."""
    return train_fraud_type(spark, d).where(F.col("class").isin(FRAUD_TYPES) & (F.col("support") > 0)).select(
        F.col("class").alias("label"), F.col("support").cast("long").alias("support")
    )


@query(
    "M7_at_optimum",
    SPLIT_SQL + """ SELECT count(*) AS rows_fitted, count(*) FILTER (WHERE is_fraud) AS frauds_fitted,
  CAST(0 AS DOUBLE) AS steepest FROM split WHERE NOT in_test""",
)
def at_optimum(spark, d):
    """The steepest slope of the penalised loss at the logistic fit, over the rows it was fitted to."""
    trained = candidates(spark, d)[0]
    model = trained.model("logistic_regression")
    ready = learning.as_reals(trained.train_rows).withColumn("label", learning.normalise_label(F.col("is_fraud")).cast("double"))
    ready = training.materialise(_prepared(model, learning.with_weights(ready, "label")), "prepared")
    total = ready.agg(F.sum("weight")).first()[0]
    last = model.stages[-1]
    slopes = ensembles.logistic_gradient(ready, last.coefficients.tolist(), last.intercept, 1 / total, "label", "x", "weight")
    steepest = F.round(F.lit(max(map(abs, slopes))), 4)
    return ready.agg(F.count(F.lit(1)).alias("rows_fitted"), F.count_if(F.col("label") == 1).alias("frauds_fitted"), F.max(steepest).alias("steepest"))


def _prepared(model, rows):
    """Rows with ``x``, what the model's last stage is given."""
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    return rows.withColumn("x", vector_to_array("features"))


def _apart(spark, d, name, score):
    trained, _, test = candidates(spark, d)
    model = trained.model(name)
    path = work_dir(spark, "ensemble")
    model.stages[-1].save(path)
    rows = training.materialise(_prepared(model, learning.as_reals(test)).select("transaction_id", "is_fraud", "x"), "prepared")
    again = score(rows.select("transaction_id", "x"), ensembles.node_table(spark, path), model.stages[-1].getMaxDepth(), "transaction_id", "x")
    ours = _scored_by(spark, d, name).select("transaction_id", F.col("score").alias("fitted_score"))
    both = rows.join(ours, "transaction_id").join(again, "transaction_id", "left")
    apart = ~F.coalesce(F.abs(F.col("score") - F.col("fitted_score")) < 1e-9, F.lit(False))
    return both.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"), F.count_if(apart).alias("apart"))


APART_SQL = SPLIT_SQL + " SELECT is_fraud, count(*) AS n, CAST(0 AS BIGINT) AS apart FROM split WHERE in_test GROUP BY 1"


@query("M8_scored_by_nodes", APART_SQL)
def forest_by_nodes(spark, d):
    """Test rows that the forest's table of nodes scores otherwise than the model."""
    return _apart(spark, d, "random_forest", ensembles.forest_scores)


@query("M9_scored_by_nodes", APART_SQL)
def boosting_by_nodes(spark, d):
    """Test rows that the boosting's table of nodes scores otherwise than the model."""
    return _apart(spark, d, "gradient_boosting", ensembles.boosting_scores)


@query(
    "M11_confusion_matrix",
    f"""{SCORED_SQL} SELECT label AS actual, count(*) FILTER (WHERE score <= 0.5) AS predicted_0,
  count(*) FILTER (WHERE score > 0.5) AS predicted_1 FROM scored GROUP BY label""",
)
def confusion_matrix(spark, d):
    counts = metrics.confusion_counts(
        scored_rows(spark, d), F.col("label"), metrics.predicted(F.col("score"))
    )
    return metrics.confusion_matrix(counts, [0, 1])


@query(
    "M12_classification_report",
    f"""{SCORED_SQL}, m AS (SELECT label, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS guess FROM scored),
c AS (SELECT k AS class, count(*) FILTER (WHERE label = k AND guess = k) AS ok,
    count(*) FILTER (WHERE guess = k) AS claimed, count(*) FILTER (WHERE label = k) AS support
  FROM m, (VALUES (0), (1)) v(k) GROUP BY k),
r AS (SELECT CAST(class AS VARCHAR) AS class, ok / claimed AS precision, ok / support AS recall,
    2 * ok / (claimed + support) AS f1, support, ok FROM c),
a AS (SELECT class, precision, recall, f1, support FROM r
  UNION ALL SELECT 'accuracy', sum(ok) / sum(support), sum(ok) / sum(support), sum(ok) / sum(support),
    CAST(sum(support) AS BIGINT) FROM r
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT)
    FROM r)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM a""",
)
def classification_report(spark, d):
    counts = metrics.confusion_counts(
        scored_rows(spark, d), F.col("label"), metrics.predicted(F.col("score"))
    )
    return rounded(metrics.classification_report(counts))


@query(
    "M13_roc_curve",
    f"{SCORED_SQL} SELECT threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM points",
)
def roc_curve(spark, d):
    return rounded(metrics.roc_curve(points(spark, d)))


@query(
    "M13_roc_auc",
    f"""{SCORED_SQL}, w AS (SELECT
  (SELECT sum(CASE WHEN a.score > b.score THEN a.k * b.k WHEN a.score = b.score THEN 0.5 * a.k * b.k
     ELSE 0 END)
   FROM (SELECT score, count(*) AS k FROM scored WHERE label = 1 GROUP BY score) a,
        (SELECT score, count(*) AS k FROM scored WHERE label = 0 GROUP BY score) b) AS wins,
  (SELECT count(*) FROM scored WHERE label = 1) AS p, (SELECT count(*) FROM scored WHERE label = 0) AS n)
SELECT round(wins / (p * n), 6) AS roc_auc FROM w""",
)
def roc_auc(spark, d):
    return rounded(metrics.ranking_scores(points(spark, d)).select("roc_auc"))


@query(
    "M14_pr_curve",
    f"{SCORED_SQL} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM points",
)
def pr_curve(spark, d):
    return rounded(metrics.pr_curve(points(spark, d)))


@query(
    "M14_average_precision",
    f"{SCORED_SQL} SELECT round(sum(pos * tp / (tp + fp)) / max(p), 6) AS pr_auc FROM points",
)
def average_precision(spark, d):
    return rounded(metrics.ranking_scores(points(spark, d)).select("pr_auc"))


TABLE_SQL = """SELECT position, round(threshold, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
    round(tp / p, 6) AS recall FROM points
  UNION ALL SELECT max(scores), 1.0, 1.0, 0.0 FROM points"""


@query("M15_threshold_table", f"{SCORED_SQL} {TABLE_SQL}")
def threshold_table(spark, d):
    return rounded(metrics.threshold_table(points(spark, d)))


@query(
    "G5_sampled_rows",
    f"""{SCORED_SQL}, t AS ({TABLE_SQL}) SELECT * FROM t
WHERE position % greatest(1, (SELECT count(*) // 10 FROM t)) = 0""",
)
def sampled_rows(spark, d):
    return rounded(metrics.sampled_rows(points(spark, d)))


# Three fixed score columns stand for three models.
THREE_SQL = f"""WITH {TX_SQL}, s AS (
  SELECT 'logistic_regression' AS model, CAST(is_fraud AS INTEGER) AS label,
    ((id * 7919) % 1000) / 1000.0 AS score FROM tx
  UNION ALL SELECT 'random_forest', CAST(is_fraud AS INTEGER), least(1.0, CAST(amount AS DOUBLE) / 400) FROM tx
  UNION ALL SELECT 'gradient_boosting', CAST(is_fraud AS INTEGER), risk_score / 100.0 FROM tx),
t AS (SELECT model, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY 1, 2),
q AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p,
    sum(neg) OVER (PARTITION BY model) AS n
  FROM t WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


def three_models(spark, d):
    """Ranking scores of the three score columns."""
    tx = tx_events(spark, d)
    columns = {
        "logistic_regression": ((F.col("id") * 7919) % 1000) / 1000.0,
        "random_forest": F.least(F.lit(1.0), F.col("amount").cast("double") / 400),
        "gradient_boosting": F.col("risk_score") / 100.0,
    }
    three = F.array(
        *[F.struct(F.lit(n).alias("model"), c.alias("score")) for n, c in columns.items()]
    )
    scored = tx.select(F.col("is_fraud").cast("int").alias("label"), F.inline(three))
    by = ("model",)
    return metrics.ranking_scores(metrics.score_points(scored, by=by), by=by)


@query(
    "M16_model_selection",
    f"""{THREE_SQL} SELECT model, round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 6) AS roc_auc,
  round(sum(pos * tp / (tp + fp)) / max(p), 6) AS pr_auc FROM q GROUP BY model
ORDER BY sum(pos * tp / (tp + fp)) / max(p) DESC, model LIMIT 1""",
)
def model_selection(spark, d):
    return rounded(metrics.best_model(three_models(spark, d)))


@query("M16_trained_model_scores")
def trained_model_scores(spark, d):
    return candidates(spark, d)[0].scores


@query("M17_feature_importance")
def feature_importance(spark, d):
    trained = candidates(spark, d)[0]
    parts = [
        learning.importances(model).withColumn("model", F.lit(name))
        for name, model in trained.models.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "M17_importance_totals",
    "SELECT model, 1.0::DOUBLE AS total FROM (VALUES ('random_forest'), ('gradient_boosting')) AS t(model)",
)
def importance_totals(spark, d):
    """The importances of a tree model add up to 1."""
    trees = feature_importance(spark, d).where(F.col("model") != "logistic_regression")
    return trees.groupBy("model").agg(F.round(F.sum("importance"), 6).alias("total"))


@query("M18_model_persist")
def model_persist(spark, d):
    """Scores of the saved and reloaded pipeline next to those of the one in memory."""
    trained, types, _, test = fitted(spark, d)
    path = work_dir(spark, "model")
    training.save_model(path, trained.best_model, types)
    model, _, _ = training.load_model(path)
    before = training.score_rows(trained.best_model, test, "kept")
    after = training.score_rows(model, test, "loaded").select(
        "transaction_id", F.col("score").alias("loaded_score")
    )
    return before.select("transaction_id", "score").join(after, "transaction_id")


@query("M18_scores_apart", APART_SQL)
def scores_apart(spark, d):
    """Test rows, by class, and those that the reloaded pipeline scores otherwise than the one in memory."""
    _, _, _, test = fitted(spark, d)
    both = test.select("transaction_id", "is_fraud").join(model_persist(spark, d), "transaction_id", "left")
    apart = ~F.coalesce(F.abs(F.col("score") - F.col("loaded_score")) < 1e-9, F.lit(False))
    return both.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"), F.count_if(apart).alias("apart"))


@query("M19_score_batch")
def score_batch(spark, d):
    trained, types, features, _ = fitted(spark, d)
    return scoring.score_batch(features, trained.best_model, types)


@query("M19_score_report")
def score_report(spark, d):
    trained, types, features, _ = fitted(spark, d)
    return scoring.score_report(scoring.score_batch(features, trained.best_model, types))


@query(
    "M19_decisions_apart",
    f"""WITH {TX_SQL} SELECT is_fraud AS labelled, count(*) AS n, CAST(0 AS BIGINT) AS flags_apart,
  CAST(0 AS BIGINT) AS types_apart FROM tx GROUP BY 1""",
)
def decisions_apart(spark, d):
    """Scored rows by label; those whose flag isn't the probability's, and those that have a scenario without a flag."""
    _, _, features, _ = fitted(spark, d)
    flagged = F.col("fraud_probability") > 0.5
    labels = features.select("transaction_id", F.col("is_fraud").alias("labelled"))
    return score_batch(spark, d).join(labels, "transaction_id").groupBy("labelled").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_fraud") != flagged).alias("flags_apart"),
        F.count_if(~F.col("is_fraud") & F.col("fraud_type").isNotNull()).alias("types_apart"),
    )
