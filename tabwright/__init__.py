"""Spark-native preparation, profiling and modelling of tabular data.

Every operator takes a DataFrame and returns a DataFrame (or a fitted object
whose ``transform`` does); nothing here holds rows on the driver.
"""

from tabwright.session import checkpoint_root, get_session

__all__ = ["get_session", "checkpoint_root"]
