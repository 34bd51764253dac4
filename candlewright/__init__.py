"""Candle-data quality and completeness on Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is collected, and the clock is always an ``as_of`` argument.
"""

__version__ = "0.1.0"
