"""lagwise: ordered-panel analytics on Spark.

Lag tables, lag correlation, an anomaly-detector ensemble, lagged regression,
sequence windows, dynamic mode decomposition with control and batch what-if
optimisation, all as DataFrame operators over an explicit row order.
"""

from .functions.correlation import best_lags, correlation_matrix, lag_correlation  # noqa: F401
from .functions.metrics import classification_metrics, regression_metrics  # noqa: F401
from .functions.scale import min_max_scale, process_features, standard_scale  # noqa: F401
from .functions.split import chrono_split, split  # noqa: F401
from .functions.stats import describe, exact_percentiles, histogram, kde, table_info, trend  # noqa: F401
from .operators.anomaly import detect_anomalies, drop_anomalies, flagged, flagged_points  # noqa: F401
from .operators.dmdc import fit_dmdc  # noqa: F401
from .operators.index import with_row_index  # noqa: F401
from .operators.lag import (best_lag_table, lag_table, lag_table_multi_target, multi_lag_table,  # noqa: F401
                            single_lag_tables)
from .operators.optimize import optimize_rows  # noqa: F401
from .operators.regression import builders, fit_multi_target, forecast_horizon, lag_sweep, ols_summary  # noqa: F401
from .operators.rolling import decoder_inputs, hankel_snapshots, rolling_stats, sequence_windows  # noqa: F401
from .session import checkpoint_dir, durable, get_spark  # noqa: F401
from .sources.io import read_panel, write_panel  # noqa: F401

__version__ = "0.1.0"
