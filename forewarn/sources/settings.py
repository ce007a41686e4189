"""Country settings: which zones, box and thresholds a run uses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CountrySettings:
    """One run's choices; they enter the plan as literals and are pushed to the scans."""

    name: str
    lat: tuple[float, float]
    lon: tuple[float, float]
    first_date: str
    last_date: str
    quantile: int = 95

    def restrict(self, df: DataFrame, lat: str, lon: str, date: str) -> DataFrame:
        return df.where(F.col(lat).between(*self.lat) & F.col(lon).between(*self.lon)
                        & F.col(date).between(F.lit(self.first_date).cast("date"),
                                              F.lit(self.last_date).cast("date")))
