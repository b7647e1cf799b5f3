"""Minimum samples and method settings, overridable per call."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Gates:
    """Below a gate an operator answers with a refusal row instead of a number."""

    alpha: float = 0.05
    correlation: int = 30
    annual: int = 6
    stationarity: int = 30
    cointegration: int = 60
    describe: int = 3
    outliers: int = 10
    trend: int = 10
    seasonal_months: int = 24
    seasonal_years: int = 2
    outlier_z: float = 3.0
    threshold_buckets: int = 5
    max_lag: int = 60
    granger_max_lag: int = 10
    rolling_window: int = 30
    gap_days: int = 45


GATES = Gates()
