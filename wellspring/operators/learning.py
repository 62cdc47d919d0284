"""Models on prepared columns, with Spark ML."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions.nulls import nan_to_null, number, numeric_columns, text_columns
from wellspring.operators.forest import fit_forest
from wellspring.operators.imputation import column_medians, missing_counts
from wellspring.operators.quantiles import column_percentiles
from wellspring.session import settle

MISSING = "missing"
TREES = 100
ROWS_PER_TASK = 500_000
SEED = 42

# Columns that are no input of a model.
NON_FEATURES = [
    "Record_ID", "API_Well_ID", "DateTime", "Type_Damage", "Phase_Operation", "Formation_Type",
    "Clay_Mineralogy_Type", "Completion_Type", "Mud_Type", "Active_Damage",
]
UNHELPFUL = ["Record_ID", "API_Well_ID", "DateTime", "Phase_Operation", "Completion_Type", "Type_Damage"]


class MedianScalerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """``facts`` has the median, mean and deviation of each column; it is kept as JSON so that the model can be saved."""

    def __init__(self, facts: dict[str, tuple[float, float, float]] | None = None, ending: str = "_scaled"):
        super().__init__()
        self.known = Param(self, "known", "median, mean and deviation of each column, as JSON", TypeConverters.toString)
        self.suffix = Param(self, "suffix", "ending of the new columns", TypeConverters.toString)
        self._set(known=json.dumps(facts or {}), suffix=ending)

    @property
    def facts(self) -> dict[str, list[float]]:
        return json.loads(self.getOrDefault(self.known))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ending = self.getOrDefault(self.suffix)
        return dataset.withColumns({
            c + ending: (F.coalesce(number(F.col(f"`{c}`")), F.lit(median)) - mean) / (std or 1.0)
            for c, (median, mean, std) in self.facts.items()
        })


class MedianScaler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fills gaps, NaN included, with the exact median and scales by the population deviation."""

    def __init__(self, columns: Sequence[str] = (), ending: str = "_scaled"):
        super().__init__()
        self.inputs = Param(self, "inputs", "columns to scale", TypeConverters.toListString)
        self.suffix = Param(self, "suffix", "ending of the new columns", TypeConverters.toString)
        self._set(inputs=list(columns), suffix=ending)

    def _fit(self, dataset: DataFrame) -> MedianScalerModel:
        columns = self.getOrDefault(self.inputs)
        known = nan_to_null(dataset)
        medians = {c: v[0] or 0.0 for c, v in column_percentiles(known, columns, [0.5]).items()}
        filled = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians[c])) for c in columns}
        row = known.agg(*[
            f(filled[c]).alias(f"{n}{i}") for i, c in enumerate(columns)
            for n, f in (("m", F.avg), ("s", F.stddev_pop))
        ]).first()
        return MedianScalerModel(
            {c: (medians[c], row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(columns)}, self.getOrDefault(self.suffix))


def training_rows(df: DataFrame, *columns: str) -> DataFrame:
    """The columns that a model is fitted to, dealt to all cores whatever the files are; a task has ``ROWS_PER_TASK`` rows at most.

    A fit passes over the rows for each level of the trees, and a table in one file would be a single task in each of them. More tasks
    than needed cost too, as each sends statistics of all nodes.
    """
    rows = df.select(*[F.col(f"`{c}`") for c in columns])
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS_PER_TASK))
    return rows.repartition(parts)


class SpreadForest(RandomForestClassifier):
    """Grown by ``fit_forest`` on ``training_rows``."""

    def _fit(self, dataset: DataFrame):
        return fit_forest(self, training_rows(dataset, self.getFeaturesCol(), self.getLabelCol()))


class SpreadForestRegressor(RandomForestRegressor):
    """Grown by ``fit_forest`` on ``training_rows``."""

    def _fit(self, dataset: DataFrame):
        return fit_forest(self, training_rows(dataset, self.getFeaturesCol(), self.getLabelCol()))


class MergedOneVsRest(OneVsRest):
    """Fits on equal rows merged into one with their number as ``_weight``: what boosted trees add up is the same."""

    def _fit(self, dataset: DataFrame):
        features, label = self.getFeaturesCol(), self.getLabelCol()
        merged = settle(dataset.groupBy(features, label).agg(F.count(F.lit(1)).cast("double").alias("_weight")))
        return super()._fit(training_rows(merged, features, label, "_weight"))


def build_classifier(numeric: Sequence[str], categorical: Sequence[str], label: str = "label", trees: int = TREES,
                     max_depth: int = 10, seed: int = SEED, method: str = "forest") -> Pipeline:
    """Median and scale for numbers, one-hot for texts with unseen texts ignored, then trees.

    ``method`` is "forest" for a random forest or "boosted" for gradient-boosted trees, one model of ``trees`` rounds for
    each label against the others. ``label`` is a text column; predictions come back as text in ``predicted_label``.
    """
    if method not in ("forest", "boosted"):
        raise ValueError(f"unknown method {method!r}: forest or boosted")
    setting = {"featuresCol": "features", "labelCol": "label_index"}
    if method == "forest":
        trained = SpreadForest(numTrees=trees, maxDepth=max_depth, seed=seed, **setting)
    else:
        trained = MergedOneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=max_depth, seed=seed), weightCol="_weight", **setting)
    filled = ", ".join(f"coalesce(`{c}`, '{MISSING}') AS `{c}_filled`" for c in categorical)
    stages: list = []
    if numeric:
        stages.append(MedianScaler(numeric))
    if categorical:
        stages += [
            SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
            StringIndexer(inputCols=[f"{c}_filled" for c in categorical], outputCols=[f"{c}_index" for c in categorical],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical],
                          dropLast=True),
        ]
    stages += [
        VectorAssembler(inputCols=[f"{c}_scaled" for c in numeric] + [f"{c}_hot" for c in categorical], outputCol="features"),
        StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"),
        trained,
    ]
    return Pipeline(stages=stages)


def label_texts(model: PipelineModel) -> list[str]:
    """Texts of the label index, from the last indexer of the model."""
    return [s for s in model.stages if isinstance(s, StringIndexerModel)][-1].labelsArray[0]


def predict_labels(model: PipelineModel, df: DataFrame, name: str = "predicted_label") -> DataFrame:
    """Predictions as text. Rows need no label: the label indexer is left out."""
    for stage in model.stages:
        if not (isinstance(stage, StringIndexerModel) and stage.getOutputCol() == "label_index"):
            df = stage.transform(df)
    return IndexToString(inputCol="prediction", outputCol=name, labels=label_texts(model)).transform(df)


def training_selection(df: DataFrame, label: str, drop: Sequence[str] = NON_FEATURES) -> tuple[DataFrame, list[str]]:
    """Label and numeric feature columns, and the names of the features."""
    features = [c for c in numeric_columns(df.drop(*drop)) if c != label]
    return df.select(label, *[f"`{c}`" for c in features]), features


def split_rows(df: DataFrame, test_share: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The rows to learn from, which every stage of a fit passes over, are written once; each pass would sort the whole table again."""
    train, test = df.randomSplit([1 - test_share, test_share], seed)
    return settle(train), test


def accuracy(predicted: DataFrame, label: str = "label_index") -> float:
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy").evaluate(predicted)


def mean_squared_error(predicted: DataFrame, label: str) -> float:
    return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mse").evaluate(predicted)


def cluster_rows(df: DataFrame, columns: Sequence[str], k: int, seed: int = SEED, name: str = "cluster") -> DataFrame:
    """Number of the k-means cluster of each row, on scaled columns."""
    scaled = MedianScaler(columns, "_unit").fit(df).transform(df)
    ready = VectorAssembler(inputCols=[f"{c}_unit" for c in columns], outputCol="_features").transform(scaled)
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=name).fit(training_rows(ready, "_features"))
    return model.transform(ready).drop("_features", *[f"{c}_unit" for c in columns])


def forest_impute(df: DataFrame, columns: Sequence[str] | None = None, trees: int = TREES, max_depth: int = 10,
                  seed: int = SEED) -> tuple[DataFrame, dict[str, int]]:
    """Fill column after column with a random forest on the numeric columns; earlier fills serve later ones.

    Texts are classified, numbers regressed; a filled number is a double, known cells stay as they are. Gaps in the
    predictors are bridged by the median. A column without any value stays empty. The table is written once; what is
    written again for each column are the predictors and targets of the rows with gaps, joined to their rows at the
    end. Returns the filled rows and the number of empty cells that each column had.
    """
    clean = nan_to_null(df)
    numbers = numeric_columns(clean, include_boolean=True)
    texts = text_columns(clean)
    wanted = [c for c in (columns or clean.columns) if c in numbers + texts]
    gone = {c: n for c, n in missing_counts(clean, wanted).items() if n}
    if not gone:
        return clean, gone
    plain = [c for c in numbers if not isinstance(clean.schema[c].dataType, T.BooleanType)]
    medians = column_medians(clean, plain)
    inputs = {c: f"_in_{i}" for i, c in enumerate(numbers)}
    targets = {c: f"_to_{i}" for i, c in enumerate(gone)}
    # For the predictors all gaps are bridged once; a filled column replaces its bridge.
    table = settle(clean.withColumns({
        **{inputs[c]: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians.get(c) or 0.0)) for c in numbers},
        **{to: F.col(f"`{c}`").cast("double") if c in plain else F.col(f"`{c}`") for c, to in targets.items()},
        "_row": F.monotonically_increasing_id()}))
    lacking = F.lit(False)
    for to in targets.values():
        lacking = lacking | F.col(to).isNull()
    narrow = ["_row", *targets.values(), *inputs.values()]
    whole, state = table.where(~lacking), table.where(lacking).select(*narrow)
    for c, to in targets.items():
        used = [name for other, name in inputs.items() if other != c]
        assembler = VectorAssembler(inputCols=used, outputCol="_features")
        known = assembler.transform(whole.select(to, *used).unionByName(state.where(F.col(to).isNotNull()).select(to, *used)))
        if known.isEmpty():
            continue
        guessed, value = _forest_guess(known, assembler.transform(state), to, c in texts, trees, max_depth, seed)
        if c in numbers and c not in plain:
            value = value >= 0.5
        filled = guessed.withColumn(to, F.coalesce(F.col(to), value))
        if c in numbers:
            filled = filled.withColumn(inputs[c], F.col(to).cast("double"))
        state = settle(filled.select(*narrow))
    shown = [F.col(targets.get(c, f"`{c}`")).alias(c) for c in clean.columns]
    opened = table.where(lacking).drop(*targets.values()).join(state.select("_row", *targets.values()), "_row")
    return whole.select(*shown).unionByName(opened.select(*shown)), gone


def _forest_guess(known: DataFrame, rows: DataFrame, target: str, as_text: bool, trees: int, max_depth: int,
                  seed: int) -> tuple[DataFrame, Column]:
    """``rows`` with the predictions of a forest fitted to ``known``, and the predicted value of ``target``."""
    setting = {"featuresCol": "_features", "predictionCol": "_guess", "numTrees": trees, "maxDepth": max_depth, "seed": seed}
    if not as_text:
        fitted = SpreadForestRegressor(labelCol="_y", featureSubsetStrategy="all", **setting).fit(known.withColumn("_y", F.col(target).cast("double")))
        return fitted.transform(rows), F.col("_guess")
    indexer = StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc").fit(known)
    fitted = SpreadForest(labelCol="_y", **setting).fit(indexer.transform(known))
    named = IndexToString(inputCol="_guess", outputCol="_text", labels=indexer.labels)
    return named.transform(fitted.transform(rows)), F.col("_text")
