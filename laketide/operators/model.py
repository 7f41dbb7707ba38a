"""Classifier training, scoring and metrics on MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laketide.functions.scalars import row_fingerprint
from laketide.operators.windows import HOT_ROWS, prefix_sums, range_chunks
from laketide.session import fresh_dir
from laketide.sources.writers import stored

# Forest size, score limits of the review queue.
TREES, DEPTH, SEED = 100, 10, 42
HIGH_RISK = 0.8


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights ``rows / (classes * rows of the class)``. One row per class comes to
    the driver: labels are classes, so their number is small."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    rows = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(rows / (len(counts) * n))).otherwise(weight)
    return df.withColumn(name, weight)


def train_forest(
    df: DataFrame, features: Sequence[str], label: str, trees: int = TREES, depth: int = DEPTH, path: str | None = None
) -> PipelineModel:
    """Train, store at ``path`` (a new folder of the shared one by default) and return the
    stored model. A freshly fitted model drags its training summary, and with it the session,
    into every scoring task; a loaded one does not."""
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    where = path or fresh_dir(df.sparkSession, "forest")
    Pipeline(stages=[assembler, forest]).fit(with_class_weights(df, label)).write().overwrite().save(where)
    return PipelineModel.load(where)


def score(df: DataFrame, model: PipelineModel, features: Sequence[str], version: str, at: Column) -> DataFrame:
    """Scored rows with what an audit needs: model version, input hash, time."""
    scored = model.transform(df)
    return scored.withColumns(
        {
            "score": vector_to_array("probability")[1],
            "model_version": F.lit(version),
            "input_hash": row_fingerprint(features),
            "scored_at": at,
        }
    ).drop("features", "rawPrediction", "probability")


def importances(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    values = model.stages[-1].featureImportances.toArray()
    return dict(sorted(zip(features, map(float, values)), key=lambda p: -p[1]))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy from one aggregate."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        }
    )


def auc(df: DataFrame, label: str, score_col: str, chunks: int = 256, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact area under the ROC curve, ties counted half: over distinct scores,
    ``sum(pos * (neg_below + neg_equal / 2)) / (pos * neg)``."""
    x = df.select(F.col(label).cast("int").alias("y"), F.col(score_col).cast("double").alias("s"))
    counts = stored(x.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "score_counts")
    chunk = partial(range_chunks, counts, "s", chunks)
    running = prefix_sums(counts, [], ["s"], {"below": F.col("neg")}, chunk, inclusive=False, hot_rows=hot_rows)
    won = F.sum((F.col("pos") * (2 * F.col("below") + F.col("neg"))).cast("decimal(38,0)"))
    pairs = F.sum("pos").cast("decimal(19,0)") * F.sum("neg").cast("decimal(19,0)")
    return running.agg((F.try_divide(won.cast("double"), (2 * pairs).cast("double"))).alias("auc"))


def review_queue(df: DataFrame, limit: float = HIGH_RISK) -> DataFrame:
    return df.where(F.col("score") > limit)
