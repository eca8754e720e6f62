"""panelcast: multi-horizon forecasting of many ordered series on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run in Python workers (mapInPandas,
# applyInPandas) are shipped by value, so executors need pyspark, numpy and
# pandas but not this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from panelcast.plans.forecast import ForecastConfig, ForecastResult, forecast_horizon, forecast_panel  # noqa: E402
from panelcast.sources.panel import as_panel  # noqa: E402

__all__ = ["ForecastConfig", "ForecastResult", "as_panel", "forecast_horizon", "forecast_panel"]
