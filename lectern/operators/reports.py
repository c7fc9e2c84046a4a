"""Report tables: combined long table, key findings, prediction summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.insights import shown

# Section names of the combined report table, in order.
SECTIONS = {
    "summary_statistics": "Summary Statistics",
    "distributions": "Distribution Analysis",
    "correlations": "Correlation Analysis",
    "t_test_engagement": "Hypothesis Test",
    "anova_engagement": "Hypothesis Test",
    "regression": "ML - Regression",
    "classification": "ML - Classification",
    "clustering": "ML - Clustering",
}


def combined_report(results: dict[str, DataFrame]) -> DataFrame:
    """All result frames under each other by column name, with their section."""
    out = None
    for key, section in SECTIONS.items():
        if key not in results:
            continue
        df = results[key]
        part = df.select(F.lit(section).alias("section"), *df.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no results")
    return out


def key_findings(results: dict[str, DataFrame]) -> DataFrame:
    """One line of text per test and model that is present."""
    parts = []
    verdict = F.when(F.col("significant"), "significant").otherwise("not significant")
    for key in ("t_test_engagement", "anova_engagement"):
        if key in results:
            line = F.format_string("%s: p=%s (%s)", F.col("test"), shown("p_value", 4), verdict)
            parts.append(results[key].select(line.alias("finding")))
    texts = {
        "regression": ("Regression (%s): R2=%s, RMSE=%s", ["model_type"], ["r2", "rmse"]),
        "classification": ("Classification (%s): Accuracy=%s, F1=%s", ["model_type"], ["accuracy", "f1"]),
        "clustering": ("Clustering (%s): %s clusters, silhouette=%s", ["method", "n_clusters"], ["silhouette_score"]),
    }
    for key, (text, names, numbers) in texts.items():
        if key in results:
            cells = [F.col(n).cast("string") for n in names] + [shown(n, 3) for n in numbers]
            parts.append(results[key].select(F.format_string(text, *cells).alias("finding")))
    out = None
    for i, part in enumerate(parts):
        tagged = part.select(F.lit(i).alias("line"), "finding")
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no results")
    return out.orderBy("line")


def prediction_summary(metrics: DataFrame) -> DataFrame:
    """One row per model: task and quality."""
    names = {
        "task": "Task", "model_type": "Model", "accuracy": "Accuracy", "precision": "Precision", "recall": "Recall",
        "f1": "F1", "auc_roc": "AUC-ROC", "cv_mean_accuracy": "CV Accuracy",
    }
    return metrics.select(*[F.col(c).alias(n) for c, n in names.items()])
