"""Models over selected features, their artifacts, and scoring of new cards from files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline import config as C
from turfline.operators import clean, derived, selection
from turfline.plans import features
from turfline.sources import files


def _inputs(df: DataFrame, selected: Sequence[str], texts: Sequence[str]) -> DataFrame:
    return clean.model_inputs(df, selected, texts, "in_")


def fit(train: DataFrame, val: DataFrame, selected: Sequence[str], target: str = "won", trees: int = 20, seed: int = C.SelectionConfig().seed) -> tuple[PipelineModel, IsotonicRegressionModel, list[str]]:
    """Boosted trees on train, a calibration of their probabilities on val, and the names of text features."""
    kinds = dict(train.dtypes)
    texts = [c for c in selected if kinds[c] == "string"]
    rows = _inputs(train, selected, texts).withColumn("label", F.col(target).cast("double"))
    index = [StringIndexer(inputCols=[f"in_{c}" for c in texts], outputCols=[f"ix_{c}" for c in texts], handleInvalid="keep")] if texts else []
    most = max([30, *rows.agg(*[F.countDistinct(f"in_{c}") for c in texts]).first()]) if texts else 30
    pack = VectorAssembler(inputCols=[f"ix_{c}" if c in texts else f"in_{c}" for c in selected], outputCol="model_features", handleInvalid="keep")
    trees_ = GBTClassifier(featuresCol="model_features", labelCol="label", maxIter=trees, maxDepth=4, stepSize=0.1, maxBins=most + 2, seed=seed)
    model = Pipeline(stages=[*index, pack, trees_]).fit(rows)
    judged = _raw(model, val, selected, texts).withColumn("label", F.col(target).cast("double")).select("label", "raw_prob")
    return model, IsotonicRegression(featuresCol="raw_prob", labelCol="label", predictionCol="model_prob").fit(judged), texts


def _raw(model: PipelineModel, df: DataFrame, selected: Sequence[str], texts: Sequence[str]) -> DataFrame:
    return model.transform(_inputs(df, selected, texts)).withColumn("raw_prob", vector_to_array("probability")[1])


def save(spark: SparkSession, folder: str, model: PipelineModel, calibrator: IsotonicRegressionModel, selected: Sequence[str], texts: Sequence[str]) -> None:
    model.write().overwrite().save(f"{folder}/model")
    calibrator.write().overwrite().save(f"{folder}/calibrator")
    files.write_report(spark, f"{folder}/selected.json", {"selected": list(selected), "texts": list(texts)})


def score(df: DataFrame, folder: str) -> DataFrame:
    """Identifiers and selected features of df's rows with model_prob, from saved artifacts."""
    spark = df.sparkSession
    names = json.loads(files.read_text(spark, f"{folder}/selected.json"))
    model, calibrator = PipelineModel.load(f"{folder}/model"), IsotonicRegressionModel.load(f"{folder}/calibrator")
    scored = calibrator.transform(_raw(model, df, names["selected"], names["texts"]))
    return scored.select(*[c for c in dict.fromkeys((*C.ID_COLUMNS, *names["selected"])) if c in df.columns], "model_prob")


def train_from_cards(
    spark: SparkSession, cards: Sequence[str], folder: str, config: C.SelectionConfig = C.SelectionConfig(), trees: int = 20, history_config: C.HistoryConfig = C.HistoryConfig(), elo_config: C.EloConfig = C.EloConfig()
) -> selection.Selector:
    """Cleans cards, builds features, selects, fits and calibrates, and saves model, state, names and reports under folder.

    Runners and features are written once for each state of the card files, their order and the settings, and taken from
    there when all of these come again.
    """
    key = files.snapshot_key(spark, cards, features.VERSION)
    make = lambda: clean.prepare_inputs(clean.clean(clean.standardize_names(files.read_cards(spark, cards))))
    runners = files.reuse_or_write(spark, f"{folder}/runners.parquet", key, make)
    files.write_report(spark, f"{folder}/validation.json", clean.validate(runners))
    built = files.snapshot_key(spark, cards, features.VERSION, history_config, elo_config)
    table = files.reuse_or_write(spark, f"{folder}/features.parquet", built, lambda: features.build(runners, True, history_config, elo_config, keep_prices=True))
    files.write_feature_names(table, f"{folder}/feature_names.txt")
    split = selection.with_split(table)
    part = {x: split.where(F.col("split") == x) for x in ("train", "val")}
    chosen = selection.Selector(config).fit(part["train"], part["val"])
    save(spark, folder, *(lambda m, c, t: (m, c, chosen.kept, t))(*fit(part["train"], part["val"], chosen.kept, trees=trees)))
    files.write_report(spark, f"{folder}/report.json", chosen.report)
    files.write_text(spark, f"{folder}/selected_names.txt", "".join(f"{c}\n" for c in sorted(chosen.kept)))
    if chosen.importances is not None:
        files.write_csv(chosen.top(30), f"{folder}/importances")
    features.save_state(runners, folder, history_config, elo_config)
    return chosen


def score_cards(spark: SparkSession, cards: str, folder: str, out: str) -> DataFrame:
    """Scores new cards, which need no results, from the artifacts and the state under folder; writes a CSV to out."""
    new = clean.prepare_inputs(clean.clean(clean.standardize_names(files.read_cards(spark, [cards])), scoring=True))
    made = clean.drop_leakage(derived.all_groups(features.resume(spark, folder, new), legacy=True), parts=C.RESULT_PARTS)
    scored = score(made, folder)
    files.write_csv(scored, out)
    return scored
