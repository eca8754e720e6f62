"""Column-level building blocks (built-in Spark expressions only)."""

from panelcast.functions.series import (
    actual_name,
    all_present,
    clamped_lead,
    delta_name,
    diff_name,
    difference,
    forecast_name,
    is_present,
    lag,
    lag_name,
    moving_average,
    moving_avg_name,
    sign_name,
    trend_sign,
)

__all__ = [
    "actual_name",
    "all_present",
    "clamped_lead",
    "delta_name",
    "diff_name",
    "difference",
    "forecast_name",
    "is_present",
    "lag",
    "lag_name",
    "moving_average",
    "moving_avg_name",
    "sign_name",
    "trend_sign",
]
