"""regimen: Spark-native tabular regression analytics.

Every operator is a function ``f(df, *, features, label, ...) -> DataFrame``
that builds a lazy plan; fitted statistics are one-row DataFrames that are
broadcast back, never collected row data.
"""

from regimen.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
