"""The rows of prediction tasks are prepared side by side."""

import threading

import pytest

from lectern.operators import models


@pytest.fixture
def meet():
    """Returns only if `n` callers wait at the same time."""

    def make(n):
        barrier = threading.Barrier(n)
        return lambda: barrier.wait(timeout=20)

    return make


def test_prediction_tasks_are_prepared_side_by_side(spark, monkeypatch, meet):
    rows = [(str(i), i % 4, float(i % 7), float((i * 37) % 101), i % 3) for i in range(60)]
    matrix = spark.createDataFrame(rows, "email string, courses_enrolled long, total_hours double, avg_progress double, courses_completed long")
    plain = {
        "dropout": models.dropout_label(matrix), "completion": models.completion_label(matrix), "high_performer": models.high_performer_label(matrix),
    }
    plain = {task: models.train_and_score(df, task, "logistic_regression")["metrics"].collect() for task, df in plain.items()}
    wait, with_folds = meet(3), models.with_folds

    def slow(df, folds, seed=models.SEED):
        wait()
        return with_folds(df, folds, seed)

    monkeypatch.setattr(models, "with_folds", slow)
    found = models.all_predictions(matrix, "logistic_regression")
    assert {task: parts["metrics"].collect() for task, parts in found.items()} == plain
