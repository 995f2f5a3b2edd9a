"""Training, storing and applying the churn classifier with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerpulse.operators.features import CATEGORICAL, select_features
from ledgerpulse.operators.scores import at_risk, rank_by_risk, roc_auc, threshold_metrics, with_risk
from ledgerpulse.operators.splits import SEED, TEST_SIZE, stratified_split
from ledgerpulse.session import stage
from ledgerpulse.sources.versions import latest_version, new_version

# Fixed values of the two classifiers.
MAX_ITERATIONS = 1000
TOLERANCE = 1e-6
TREES = 100
DEPTH = 10
METRICS = ("auc", "precision", "recall", "f1")


@dataclass
class ChurnModel:
    pipeline: PipelineModel
    model_type: str
    feature_names: list[str]
    metrics: dict[str, float]

    def score(self, features: DataFrame) -> DataFrame:
        """Churn probability, revenue and risk score of every customer, riskiest first."""
        return rank_by_risk(with_risk(self.probabilities(features)))

    def probabilities(self, features: DataFrame) -> DataFrame:
        scored = self.pipeline.transform(features)
        return scored.select(
            *features.columns, vector_to_array("probability").getItem(1).alias("churn_probability")
        )

    def feature_importance(self, spark: SparkSession) -> DataFrame:
        """Importance per feature, largest first; empty for the logistic model."""
        model = self.pipeline.stages[-1]
        values = model.featureImportances.toArray() if self.model_type != "logistic" else []
        rows = [(name, float(value)) for name, value in zip(self.feature_names, values)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature"
        )

    def save(self, spark: SparkSession, path: str) -> str:
        """A new version below ``path``: the pipeline, and names and metrics as JSON."""
        row = [(self.model_type, self.feature_names, *[self.metrics.get(m) for m in METRICS])]
        schema = "model_type string, feature_names array<string>, " + ", ".join(f"{m} double" for m in METRICS)
        with new_version(spark, path) as folder:
            self.pipeline.write().save(f"{folder}/pipeline")
            spark.createDataFrame(row, schema).coalesce(1).write.json(f"{folder}/metadata")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ChurnModel:
        folder = latest_version(spark, path)
        meta = spark.read.json(f"{folder}/metadata").first().asDict()
        return cls(
            PipelineModel.load(f"{folder}/pipeline"),
            meta["model_type"],
            meta["feature_names"],
            {m: meta[m] for m in METRICS if meta.get(m) is not None},
        )


def feature_stages(features: DataFrame) -> list:
    """Encode the categories, assemble and standardise.

    The encoder learns the categories when it is fitted and keeps them for
    scoring. A missing or unknown one goes to the extra index, which the
    encoder drops, so that all its columns are 0.
    """
    categories = [c for c in CATEGORICAL if c in features.columns]
    encoded = [f"{c}_encoded" for c in categories]
    stages = []
    if categories:
        indexes = [f"{c}_index" for c in categories]
        stages = [
            StringIndexer(
                inputCols=categories, outputCols=indexes, handleInvalid="keep", stringOrderType="alphabetAsc"
            ),
            OneHotEncoder(inputCols=indexes, outputCols=encoded),
        ]
    return [
        *stages,
        VectorAssembler(inputCols=select_features(features) + encoded, outputCol="raw_features"),
        scaler(),
    ]


def scaler() -> StandardScaler:
    return StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)


def classifier(model_type: str, rows: int, tolerance: float = TOLERANCE):
    """``logistic`` (L2, penalty as strong as one unit of weight) or else a forest."""
    if model_type == "logistic":
        return LogisticRegression(
            labelCol="churned",
            weightCol="class_weight",
            maxIter=MAX_ITERATIONS,
            tol=tolerance,
            regParam=1.0 / rows,
            elasticNetParam=0.0,
            standardization=False,
        )
    return RandomForestClassifier(
        labelCol="churned",
        weightCol="class_weight",
        numTrees=TREES,
        maxDepth=DEPTH,
        seed=SEED,
        featureSubsetStrategy="sqrt",
    )


def with_class_weight(train: DataFrame, positives: int, rows: int) -> DataFrame:
    """Weight rows / (2 * rows of the class), from two numbers instead of a join."""
    weight = F.when(F.col("churned") == 1, rows / (2.0 * positives)).otherwise(rows / (2.0 * (rows - positives)))
    return train.withColumn("class_weight", weight)


def train(
    features: DataFrame, model_type: str = "logistic", test_size: float = TEST_SIZE, tolerance: float = TOLERANCE
) -> ChurnModel:
    """Fit on the training part of a stratified split and measure on the rest. ``tolerance`` ends the logistic solver.

    ``features`` is read three times, so pass a stored table. Its split is
    written to the shared scratch folder; the solver and the evaluation read
    that copy.
    """
    split = stage(stratified_split(features, test_size=test_size), "split")
    known = F.coalesce(F.col("churned").isin(0, 1), F.lit(False))
    counts = split.agg(
        F.count_if(~F.col("is_test")).alias("n"),
        F.count_if(~F.col("is_test") & (F.col("churned") == 1)).alias("p"),
        F.count_if(~known).alias("unknown"),
    ).first()
    if counts.unknown:
        raise ValueError(f"{counts.unknown} rows have a label other than 0 and 1")
    if not counts.p or counts.p == counts.n:
        raise ValueError("training needs customers of both classes")
    weighted = with_class_weight(split.where(~F.col("is_test")), counts.p, counts.n)
    pipeline = Pipeline(stages=[*feature_stages(features), classifier(model_type, counts.n, tolerance)]).fit(weighted)
    model = ChurnModel(pipeline, model_type, _feature_names(pipeline, features), {})
    # scored once for both measures
    held_out = stage(model.probabilities(split.where("is_test")).select("churned", "churn_probability"), "held_out")
    quality = threshold_metrics(held_out).first()
    model.metrics = {"auc": roc_auc(held_out).first().auc, **{m: quality[m] for m in METRICS[1:]}}
    return model


def train_and_rank(features: DataFrame, model_type: str = "logistic", path: str | None = None):
    """Train, optionally store, and list the customers at risk."""
    features = stage(features, "features")
    model = train(features, model_type)
    if path:
        model.save(features.sparkSession, path)
    return model, at_risk(model.score(features))


def learned_categories(features: DataFrame) -> dict[str, list[str]]:
    """The sorted values of the category columns, as the encoder of a model learns them. ``features`` should be stored."""
    columns = [c for c in CATEGORICAL if c in features.columns]
    encoder = StringIndexer(
        inputCols=columns, outputCols=[f"{c}_index" for c in columns], handleInvalid="skip", stringOrderType="alphabetAsc"
    )
    return {c: list(labels) for c, labels in zip(columns, encoder.fit(features).labelsArray)}


def _feature_names(pipeline: PipelineModel, features: DataFrame) -> list[str]:
    names = select_features(features)
    categories = [c for c in CATEGORICAL if c in features.columns]
    if categories:
        for column, labels in zip(categories, pipeline.stages[0].labelsArray):
            names += [f"{column}_{label}" for label in labels]
    return names
