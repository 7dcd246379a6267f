"""souk — marketplace analytics and table maintenance on Spark DataFrames.

Every operator takes DataFrames (and explicit parameters such as ``as_of``)
and returns a DataFrame built from Spark's own expressions, joins, windows
and aggregates.  Nothing is collected to the driver.
"""

__all__ = ["session"]
