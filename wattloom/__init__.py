"""wattloom: half-hourly energy readings as Spark DataFrames.

Operators are plain functions `f(df, ...) -> DataFrame`, usable with `df.transform`.
"""

from .session import build_session

__all__ = ["build_session"]
