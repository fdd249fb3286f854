"""A user strategy as configuration: weighting of factors and construction of positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.operators import portfolio as po
from factorspark.operators import scoring as sc


@dataclass(frozen=True)
class Strategy:
    weighting: str = "ic"
    construction: str = "long_short"
    top_n: int = 10
    threshold: float = 0.5
    min_weight: float = 0.0
    max_weight: float = 1.0

    def weights(self, panel: DataFrame) -> DataFrame:
        m = sc.evaluate_library(panel).select("name", F.col("ic_mean").alias("ic"), "ir")
        return po.factor_weights(m, self.weighting, self.min_weight, self.max_weight)

    def signal(self, panel: DataFrame) -> DataFrame:
        """Long panel (symbol, ts, name, value, fwd) to one signal per symbol and date."""
        return po.composite(panel, self.weights(panel))

    def positions(self, panel: DataFrame) -> DataFrame:
        s = self.signal(panel).filter(F.col("signal").isNotNull())
        return po.positions(s, self.construction, ["ts"], n=self.top_n, threshold=self.threshold)
