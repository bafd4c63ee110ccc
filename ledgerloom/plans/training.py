"""Train a column detector on a directory of labelled files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ledgerloom.operators import learning
from ledgerloom.operators.features import amount_features, id_features
from ledgerloom.sources.store import checkpoint_dir

FEATURES = {"id": id_features, "amount": amount_features}


@dataclass(frozen=True)
class Trained:
    """A fitted detector, its metrics on the test rows, and the split it came from."""

    kind: str
    model: PipelineModel
    metrics: DataFrame
    data: DataFrame

    def scores(self, long: DataFrame) -> DataFrame:
        return learning.confidence(self.model, FEATURES[self.kind](long))


def train(
    long: DataFrame,
    labels: DataFrame,
    kind: str,
    algorithm: str = "logistic",
    iterations: int = 100,
) -> Trained:
    """Features, split, fit and evaluation for `kind` id or amount.

    Splitting and fitting read their input many times, so the labelled set, a row per
    column of each labelled file, is checkpointed first and the files are scanned once.
    """
    checkpoint_dir(long.sparkSession)
    labelled = learning.labelled_set(FEATURES[kind](long), labels).checkpoint()
    data = learning.split(labelled)
    model = learning.fit(data, algorithm, iterations)
    return Trained(kind, model, learning.evaluate(learning.predictions(model, data)), data)
