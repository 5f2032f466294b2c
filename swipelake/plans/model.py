"""Random Forest fraud classifier: preparation, stable split, training and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipelake.columns import DEFAULT_COLUMNS, TxnColumns, numeric_columns, present
from swipelake.fixed_values import MODEL_NUMERIC
from swipelake.functions.draws import uniform
from swipelake.scratch import scratch_path, written
from swipelake.skew import ROWS_PER_TASK, cut_by_range


@dataclass(frozen=True)
class ModelInputs:
    """Which columns the model reads."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    label: str = "is_fraud"

    @staticmethod
    def of(
        df: DataFrame,
        cols: TxnColumns = DEFAULT_COLUMNS,
        numeric: Sequence[str] | None = None,
        categorical: Sequence[str] | None = None,
    ) -> ModelInputs:
        """The wanted (or default) features that exist in ``df``."""
        numeric = numeric or (cols.amount, *MODEL_NUMERIC)
        categorical = categorical or (cols.category, "amount_bucket")
        return ModelInputs(
            tuple(present(df, numeric, "skip")),
            tuple(present(df, categorical, "skip")),
            cols.fraud,
        )


def prepare(df: DataFrame, inputs: ModelInputs) -> DataFrame:
    """NULL features to 0, label to int. Used for training and for scoring alike."""
    df = df.na.fill(0, subset=numeric_columns(df, inputs.numeric))
    if inputs.label not in df.columns:
        return df
    return df.withColumn(inputs.label, F.col(inputs.label).cast("int"))


def with_split(
    df: DataFrame, id_column: str, label: str, test_ratio: float = 0.2, seed: int = 42
) -> DataFrame:
    """``is_test`` from a hash of id and class: the same rows on any cluster, without a shuffle.

    Each class is drawn on its own, so both keep the ratio. Rows without label are dropped.
    """
    key = F.concat_ws(":", F.col(label).cast("string"), F.col(id_column).cast("string"))
    labelled = df.filter(F.col(label).isin(0, 1))
    return labelled.withColumn("is_test", uniform(key, seed, "split") < test_ratio)


def split(
    df: DataFrame, id_column: str, label: str, test_ratio: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test)."""
    both = with_split(df, id_column, label, test_ratio, seed)
    test = F.col("is_test")
    return both.filter(~test).drop("is_test"), both.filter(test).drop("is_test")


def category_vocabulary(rows: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """``feature, value, rows``: the ``most`` commonest values of each column, ties by value, NULL left out.

    All columns are counted in one shuffle, and only the chosen values leave it.
    """
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    counted = rows.select(F.inline(F.array(*pairs))).filter("value is not null").groupBy("feature", "value").count()
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("count"), "value"))
    kept = counted.withColumn("place", place).filter(F.col("place") <= most)
    return kept.select("feature", "value", F.col("count").alias("rows"))


def bound_categories(rows: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """``rows`` with all but the ``most`` commonest values of each category column set to NULL."""
    if not columns:
        return rows
    vocabulary = written(category_vocabulary(rows, columns, most), "vocabulary")
    for c in columns:
        # At most ``most`` values.
        known = vocabulary.filter(F.col("feature") == c).select(F.col("value").alias("_known"))
        value = F.col(c).cast("string")
        rows = rows.join(F.broadcast(known), value == F.col("_known"), "left")
        rows = rows.withColumn(c, F.col("_known")).drop("_known")
    return rows


def train(
    rows: DataFrame,
    inputs: ModelInputs,
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
    max_bins: int = 32,
) -> PipelineModel:
    """Fit indexers and forest. The needed columns are written once for all tree levels.

    A category column keeps its ``max_bins - 1`` commonest values, found on the executors; all others share the bin
    of NULL and unseen values, in training and in scoring alike. So a column may have any number of values, and an
    indexer brings at most ``max_bins - 1`` of them to the driver.

    The model is saved and read back: the copy does not hold the training summary, which keeps
    a reference to the session and cannot be sent to executors once metrics were observed in it.
    """
    used = [inputs.label, *inputs.numeric, *inputs.categorical]
    rows = bound_categories(rows.select(*dict.fromkeys(used)), inputs.categorical, max_bins - 1)
    rows = written(rows, "train")
    stages = [
        StringIndexer(inputCol=c, outputCol=f"{c}_indexed", handleInvalid="keep")
        for c in inputs.categorical
    ]
    stages.append(
        VectorAssembler(
            inputCols=[*[f"{c}_indexed" for c in inputs.categorical], *inputs.numeric],
            outputCol="features",
            handleInvalid="keep",
        )
    )
    stages.append(
        RandomForestClassifier(
            labelCol=inputs.label,
            featuresCol="features",
            numTrees=trees,
            maxDepth=depth,
            seed=seed,
            maxBins=max_bins,
            # A row's place in each tree is kept from level to level: the same trees for about half the time.
            cacheNodeIds=True,
        )
    )
    path = scratch_path(rows.sparkSession, "model")
    Pipeline(stages=stages).fit(rows).write().save(path)
    return PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame, inputs: ModelInputs) -> DataFrame:
    scored = model.transform(prepare(df, inputs))
    return scored.drop("features", *[f"{c}_indexed" for c in inputs.categorical])


def confusion_matrix(
    predictions: DataFrame, label: str = "is_fraud", prediction: str = "prediction"
) -> DataFrame:
    """One row of four counts, in one pass."""

    def counted(actual: int, said: int) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(prediction) == said))

    return predictions.agg(
        counted(1, 1).alias("true_positive"),
        counted(0, 1).alias("false_positive"),
        counted(0, 0).alias("true_negative"),
        counted(1, 0).alias("false_negative"),
    )


def class_metrics(matrix: DataFrame) -> DataFrame:
    """The four counts with accuracy and class-weighted precision, recall and F1."""
    tp, fp = F.col("true_positive"), F.col("false_positive")
    tn, fn = F.col("true_negative"), F.col("false_negative")
    total = tp + fp + tn + fn

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

    def f1(p: Column, r: Column) -> Column:
        return share(2 * p * r, p + r)

    p1, r1, p0, r0 = share(tp, tp + fp), share(tp, tp + fn), share(tn, tn + fn), share(tn, tn + fp)

    def weighted(one: Column, zero: Column) -> Column:
        return share((tp + fn) * one + (tn + fp) * zero, total)

    return matrix.select(
        "*",
        share(tp + tn, total).alias("accuracy"),
        weighted(p1, p0).alias("precision"),
        weighted(r1, r0).alias("recall"),
        weighted(f1(p1, r1), f1(p0, r0)).alias("f1_score"),
    )


def score_areas(
    predictions: DataFrame,
    label: str = "is_fraud",
    score_column: str = "score",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row: exact ``auc_roc``, ``auc_pr`` (trapezoids) and ``average_precision`` of a score.

    Rows of one score are added up, so ties count half in the ROC area and are one step of the curve. The scores are cut
    by range, highest first; each piece starts from the sums of the pieces before it. Rows without label or score
    are left out; NULL where a class is missing.
    """
    used = predictions.filter(F.col(label).isin(0, 1) & F.col(score_column).isNotNull())
    steps = used.groupBy(F.col(score_column).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    steps = written(steps, "score_steps")
    cut = cut_by_range(steps, [F.desc("_score")], steps.count(), rows_per_task)
    sums = cut.groupBy("_piece").agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    # One row for each piece.
    ahead = Window.partitionBy().orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = sums.select(
        F.col("_piece").alias("_in"),
        F.coalesce(F.sum("_p").over(ahead), F.lit(0)).alias("_p_before"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n_before"),
        F.sum("_p").over(every).cast("double").alias("_all_pos"),
        F.sum("_n").over(every).cast("double").alias("_all_neg"),
    )
    here = Window.partitionBy("_piece").orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.select("_piece", "_pos", "_neg", F.sum("_pos").over(here).alias("_tp"), F.sum("_neg").over(here).alias("_fp"))
    placed = placed.join(sums, F.col("_piece") == F.col("_in"))
    hit, miss = F.col("_tp") + F.col("_p_before"), F.col("_fp") + F.col("_n_before")
    hit_before, miss_before = hit - F.col("_pos"), miss - F.col("_neg")
    precision = hit / (hit + miss)
    last_precision = F.coalesce(F.try_divide(hit_before, hit_before + miss_before), precision)
    width = F.try_divide(F.col("_pos"), F.col("_all_pos"))
    above = F.col("_neg") * (hit_before + F.col("_pos") / 2)
    return placed.agg(
        F.sum(F.try_divide(above, F.col("_all_pos") * F.col("_all_neg"))).alias("auc_roc"),
        F.sum(width * (precision + last_precision) / 2).alias("auc_pr"),
        F.sum(width * precision).alias("average_precision"),
    )


def _named(one: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns of a one-row frame as ``metric, value`` rows."""
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return one.select(F.inline(F.array(*pairs)))


def prediction_metrics(
    predictions: DataFrame, label: str = "is_fraud", score_column: str = "score", prediction: str = "prediction"
) -> DataFrame:
    """(metric, value) rows of predictions: areas under the curves, the four counts, accuracy, precision, recall, F1."""
    classes = class_metrics(confusion_matrix(predictions, label, prediction))
    areas = score_areas(predictions, label, score_column)
    return _named(areas, areas.columns).unionByName(_named(classes, classes.columns))


def predictions_of(model: PipelineModel, test: DataFrame, inputs: ModelInputs) -> DataFrame:
    """Label, score (of class 1) and prediction of test rows, written once."""
    scored = score(model, test, inputs)
    shown = scored.select(inputs.label, vector_to_array("probability")[1].alias("score"), "prediction")
    return written(shown, "predictions")


def evaluate(model: PipelineModel, test: DataFrame, inputs: ModelInputs) -> DataFrame:
    """``prediction_metrics`` of a model on test rows."""
    return prediction_metrics(predictions_of(model, test, inputs), inputs.label)


def importances(model: PipelineModel, df: DataFrame, top: int = 15) -> DataFrame:
    """Features by importance, highest first; as many rows as features at most."""
    names = next(s for s in model.stages if isinstance(s, VectorAssembler))
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(names.getInputCols(), map(float, weights)), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows[:top], "feature string, importance double")


def summary_rows(
    predictions: DataFrame, weights: DataFrame | None, train_rows: DataFrame, label: str = "is_fraud"
) -> DataFrame:
    """Metrics of predictions, feature importances and row counts as (section, name, value) rows."""

    def section(name: str, df: DataFrame, key: str, value: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("section"), F.col(key).alias("name"), F.col(value).alias("value")
        )

    made = section("metrics", prediction_metrics(predictions, label), "metric", "value")
    if weights is not None:
        made = made.unionByName(section("importance", weights, "feature", "importance"))
    for name, df in (("train_rows", train_rows), ("test_rows", predictions)):
        count = df.agg(F.lit(name).alias("n"), F.count(F.lit(1)).cast("double").alias("v"))
        made = made.unionByName(section("rows", count, "n", "v"))
    return made


def model_summary(
    model: PipelineModel, train_rows: DataFrame, test_rows: DataFrame, inputs: ModelInputs
) -> DataFrame:
    """Metrics, importances and row counts of a fitted model as (section, name, value) rows."""
    predictions = predictions_of(model, test_rows, inputs)
    return summary_rows(predictions, importances(model, test_rows), train_rows, inputs.label)
