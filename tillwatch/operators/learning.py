"""From profile rows to fitted models: labels, derived columns, split, weights, pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    IndexToString,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.times import NO_HISTORY_DAYS
from ..schemas import DERIVED, PROFILE
from ..session import fit_cores, materialise
from . import trees
from .quantiles import exact_quantiles

# Id columns looked for in this order, and columns known only afterwards.
ID_COLUMNS = ["transaction_id", "ransaction_id", "trans_id", "id"]
LEAK_COLUMNS = ["fraud_type"]


@dataclass(frozen=True)
class ModelConfig:
    seed: int = 42
    test_size: float = 0.2
    logistic_iterations: int = 1000
    forest_trees: int = 300
    forest_depth: int = 12
    boost_iterations: int = 300
    boost_rate: float = 0.08
    boost_depth: int = 8


# --- rows --------------------------------------------------------------------------


def normalise_label(col: Column) -> Column:
    """true/1 and false/0 in any spelling as 1 and 0; anything else NULL."""
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text.isin("true", "1"), 1).when(text.isin("false", "0"), 0)


def drop_id_and_leak(df: DataFrame) -> DataFrame:
    """Without the first id column found and without columns that reveal the label."""
    ids = [c for c in ID_COLUMNS if c in df.columns][:1]
    return df.drop(*ids, *LEAK_COLUMNS)


def fit_cap(train: DataFrame) -> float:
    """The longest real dormancy in the training rows; it replaces the 9999 marker."""
    days = F.col("days_since_last_trans")
    found = train.agg(F.max(F.when(days < NO_HISTORY_DAYS, days)).alias("cap")).first()
    return float(found.cap) if found.cap is not None else 0.0


# Marker flag first, since the cap replaces the column it reads.
DERIVED_SQL = """
SELECT {others},
  IF(days_since_last_trans >= 9999, 1.0D, 0.0D) AS is_new_account_no_history,
  IF(days_since_last_trans >= 9999, {cap!r}D, days_since_last_trans) AS days_since_last_trans,
  ln(1 + greatest(trans_amount, 0.0D)) AS trans_amount_log,
  ln(1 + greatest(sender_volume_last_1h, 0.0D)) AS sender_volume_last_1h_log,
  IF(sender_txn_count_last_1h > 0, sender_volume_last_1h / sender_txn_count_last_1h, 0.0D)
    AS avg_amt_per_txn_last_1h
FROM __THIS__
"""


def derive_step(columns: list[str], cap: float) -> SQLTransformer:
    """The derived columns as a pipeline stage, so the fitted cap is saved with the model."""
    others = ", ".join(c for c in columns if c != "days_since_last_trans")
    return SQLTransformer(statement=DERIVED_SQL.format(others=others, cap=cap))


def derived_features(df: DataFrame, cap: float) -> DataFrame:
    return derive_step(df.columns, cap).transform(df)


def as_reals(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in PROFILE})


# --- split and weights -------------------------------------------------------------

LANE_DIGITS = 4


def draw(id_column: str, seed: int) -> Column:
    """A reproducible draw per row: 32 hex digits, uniform over ids."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))


def stratified_split(
    df: DataFrame, label: str, id_column: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``in_test``: exactly round(test_size * n) rows of every class.

    The rows with the lowest draws of a class are its test rows.  The draw that
    separates them is found by counting per leading digits (combined map-side) and
    ranking only the one slice it falls into, so the split itself is a projection.
    """
    drawn = df.where(F.col(label).isNotNull()).select(
        F.col(label).alias("label"), draw(id_column, seed).alias("draw")
    )
    slices = drawn.groupBy("label", F.left("draw", F.lit(LANE_DIGITS)).alias("slice")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_class = Window.partitionBy("label")
    before = per_class.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.floor(F.sum("n").over(per_class) * F.lit(test_size) + F.lit(0.5))
    cuts = (
        slices.select(
            "label",
            "slice",
            "n",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"),
            quota.alias("quota"),
        )
        .where((F.col("below") < F.col("quota")) & (F.col("below") + F.col("n") >= F.col("quota")))
        .select("label", "slice", (F.col("quota") - F.col("below")).alias("place"))
    )
    # One row per class at most: the slice holding the cut, then the cut itself.
    ranked = drawn.withColumn("slice", F.left("draw", F.lit(LANE_DIGITS))).join(
        F.broadcast(cuts), ["label", "slice"]
    )
    place = F.row_number().over(Window.partitionBy("label", "slice").orderBy("draw"))
    limits = (
        ranked.withColumn("row", place).where(F.col("row") == F.col("place")).select("label", "draw")
    ).collect()
    in_test = F.lit(False)
    for r in limits:
        in_test = in_test | ((F.col(label) == F.lit(r.label)) & (draw(id_column, seed) <= r.draw))
    return df.withColumn("in_test", F.coalesce(in_test, F.lit(False)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * n_class)."""
    counted = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    total, classes = F.sum("n").over(everything), F.count(F.lit(1)).over(everything)
    return counted.select("label", "n", (total / (classes * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, label: str) -> DataFrame:
    weights = class_weights(df, label).select(F.col("label").alias(label), "weight")
    return df.join(F.broadcast(weights), label)  # one row per class


# --- pipelines ---------------------------------------------------------------------


def preprocess_stages(columns: list[str], train: DataFrame) -> list:
    """Fill with the exact median of the training rows, centre, and divide by the population deviation (if there is any).

    The figures are written into the first stage, so they are saved with the model.
    """
    medians = {c: values[0] for (_, c), values in exact_quantiles(train, columns, [0.5]).items()}
    filled = {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(medians.get(c, 0.0))) for c in columns}
    found = train.agg(*[f(v).alias(f"{n}_{i}") for i, v in enumerate(filled.values()) for n, f in (("mean", F.mean), ("spread", F.stddev_pop))]).first()
    terms = []
    for i, c in enumerate(columns):
        mean, spread = found[f"mean_{i}"] or 0.0, found[f"spread_{i}"] or 1.0
        value = f"coalesce(if(isnan({c}), NULL, {c}), {_real(medians.get(c, 0.0))})"
        terms.append(f"({value} - {_real(mean)}) / {_real(spread)} AS {c}__scaled")
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}__scaled" for c in columns], outputCol="features"),
    ]


def _real(value: float) -> str:
    return f"double('{float(value)!r}')"


def estimators(cfg: ModelConfig, total_weight: float, label: str = "label") -> dict[str, object]:
    """The candidate models; an L2 penalty of strength 1 on the summed loss is 1 / total_weight on the mean."""
    common = {"featuresCol": "features", "labelCol": label, "weightCol": "weight"}
    return {
        "logistic_regression": LogisticRegression(
            maxIter=cfg.logistic_iterations, regParam=1.0 / total_weight, standardization=False, **common
        ),
        "random_forest": RandomForestClassifier(
            numTrees=cfg.forest_trees, maxDepth=cfg.forest_depth, seed=cfg.seed, **common
        ),
        "gradient_boosting": GBTClassifier(
            maxIter=cfg.boost_iterations,
            stepSize=cfg.boost_rate,
            maxDepth=cfg.boost_depth,
            seed=cfg.seed,
            **common,
        ),
    }


MODEL_COLUMNS = [*PROFILE, *DERIVED]


@dataclass(frozen=True)
class Ready:
    """Rows as the classifiers take them (features, label, weight), and the stages that made them."""

    rows: DataFrame
    stages: list
    total_weight: float


def ready_rows(train: DataFrame) -> Ready:
    """Profile rows with ``is_fraud``: derived, imputed, scaled and weighted.

    The saved first stage passes every input column through.
    """
    rows = (
        as_reals(train)
        .select(*PROFILE, normalise_label(F.col("is_fraud")).cast("double").alias("label"))
        .where(F.col("label").isNotNull())
    )
    return _ready(rows, "label", fit_cap(train))


def _ready(rows: DataFrame, label: str, cap: float) -> Ready:
    """``rows`` are a profile and a label.  The derived rows are written, as the medians take several passes over them."""
    derive = SQLTransformer(statement=_pass_through(derive_step([*PROFILE], cap).getStatement()))
    rows = materialise(derive.transform(with_weights(rows, label)), "derived")
    scale = preprocess_stages(MODEL_COLUMNS, rows)
    total_weight = max(1.0, rows.agg(F.sum("weight")).first()[0] or 0.0)
    for stage in scale:
        rows = stage.transform(rows)
    return Ready(rows.select("features", label, "weight"), [derive, *scale], total_weight)


def pass_partitions(n_rows: float, cores: int) -> int:
    """Even parts for fits that pass over the rows thousands of times: few rows in one, many on all cores, no part over a million."""
    return int(max(1, min(cores, n_rows // 25_000), -(-n_rows // 1_000_000)))


def in_share(ready: Ready) -> DataFrame:
    """The rows in as few parts as fill this thread's share of the cores; a fit's passes then leave the others free."""
    return ready.rows.coalesce(pass_partitions(ready.total_weight, fit_cores(ready.rows.sparkSession)))


def fit_ready(ready: Ready, name: str, cfg: ModelConfig = ModelConfig()) -> PipelineModel:
    """Fit one named model on rows that are ready."""
    estimator = estimators(cfg, ready.total_weight)[name]
    if name == "gradient_boosting":
        # Its passes are short: in as many parts as there are cores they fill what others leave free, then and later.
        cores = ready.rows.sparkSession.sparkContext.defaultParallelism
        classifier = trees.fit_boosting(estimator, ready.rows.coalesce(pass_partitions(ready.total_weight, cores)))
    elif name == "random_forest":
        classifier = trees.fit_forest(estimator, in_share(ready))
    else:
        classifier = estimator.fit(in_share(ready))
    return PipelineModel(stages=[*ready.stages, classifier])


def fit_binary(train: DataFrame, name: str, cfg: ModelConfig = ModelConfig()) -> PipelineModel:
    """Fit one named model on profile rows with ``is_fraud``: derive, impute, scale, classify."""
    return fit_ready(ready_rows(train), name, cfg)


def _pass_through(statement: str) -> str:
    """Keep all columns of a scored frame, also those unknown at training time."""
    start = statement.index("SELECT") + len("SELECT")
    end = statement.index("IF(days_since_last_trans >= 9999, 1.0D")
    return statement[:start] + " * EXCEPT (days_since_last_trans), " + statement[end:]


def fit_fraud_type(
    train: DataFrame, cfg: ModelConfig = ModelConfig()
) -> PipelineModel:
    """The scenario classifier, on fraud rows only; predicts ``predicted_fraud_type``."""
    rows = (
        as_reals(train)
        .where((normalise_label(F.col("is_fraud")) == 1) & F.col("fraud_type").isNotNull())
        .select(*PROFILE, "fraud_type")
    )
    ready = _ready(rows, "fraud_type", fit_cap(train))
    indexer = StringIndexer(
        inputCol="fraud_type", outputCol="type_index", stringOrderType="alphabetAsc"
    ).fit(ready.rows)
    forest = RandomForestClassifier(
        numTrees=cfg.forest_trees,
        maxDepth=cfg.forest_depth,
        seed=cfg.seed,
        featuresCol="features",
        labelCol="type_index",
        weightCol="weight",
        predictionCol="type_prediction",
        probabilityCol="type_probability",
        rawPredictionCol="type_raw",
    )
    names = IndexToString(
        inputCol="type_prediction", outputCol="predicted_fraud_type", labels=indexer.labels
    )
    fitted = trees.fit_forest(forest, indexer.transform(in_share(ready)))
    return PipelineModel(stages=[*ready.stages, fitted, names])


def probability(df: DataFrame) -> DataFrame:
    """Adds ``score``, the probability of the positive class, as a plain double."""
    return df.withColumn("score", vector_to_array("probability")[1])


def importances(model: PipelineModel, columns: list[str] = MODEL_COLUMNS) -> DataFrame:
    """(feature, importance) ranked; absolute coefficients for a linear model."""
    last = [s for s in model.stages if hasattr(s, "featureImportances") or hasattr(s, "coefficients")][-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = abs(last.coefficients.toArray())
    rows = [(c, float(v)) for c, v in zip(columns, values, strict=True)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
