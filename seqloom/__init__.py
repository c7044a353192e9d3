"""Spark-native analytics for sequence-targeting tables.

Every operator is a function from DataFrames to a DataFrame.  Column names are
parameters; operators project the columns they need and use ``__``-prefixed
names inside, so that further columns of the caller cannot clash.
"""

__version__ = "0.1.0"
