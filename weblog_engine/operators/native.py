"""Models of this package behind the fit / transform form of Spark ML, so that
they take part in the comparison of candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost, forest, ols

KINDS = {"boosted": boost.Boosted, "linear": ols.Linear, "forest": forest.Forest}


@dataclass
class NativeModel:
    kind: str
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and, for a classifier, ``score`` (probability)."""
        if getattr(self.model, "objective", None) in ("logistic", "share"):
            return df.withColumn("score", self.model.score()).withColumn("prediction", (F.col("score") > 0.5).cast("double"))
        return df.withColumn("prediction", self.model.score())

    def importances(self) -> list[float]:
        if self.kind in ("boosted", "forest"):
            return list(self.model.gains)
        return [abs(b) for b in self.model.coefficients]

    def to_json(self) -> str:
        return self.model.to_json()

    @staticmethod
    def from_json(kind: str, text: str) -> "NativeModel":
        return NativeModel(kind, KINDS[kind].from_json(text))


@dataclass
class BoostedFit:
    objective: str
    rounds: int
    depth: int
    rate: float
    positive_weight: float = 1.0

    def fit(self, df: DataFrame, features: list[str], label: str) -> NativeModel:
        return NativeModel("boosted", boost.fit(df, features, label, self.objective, self.rounds, self.depth, self.rate,
                                                positive_weight=self.positive_weight))


@dataclass
class ForestFit:
    objective: str
    trees: int
    depth: int
    seed: int
    weight: str | None = None

    def fit(self, df: DataFrame, features: list[str], label: str) -> NativeModel:
        return NativeModel("forest", forest.fit(df, features, label, self.objective, self.trees, self.depth, self.weight, self.seed))


class LinearFit:
    def fit(self, df: DataFrame, features: list[str], label: str) -> NativeModel:
        return NativeModel("linear", ols.fit(df, features, label))
