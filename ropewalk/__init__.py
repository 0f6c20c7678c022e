"""ropewalk - set-at-a-time analytics over agent run logs and skill records, on Spark DataFrames."""

__version__ = "0.1.0"
