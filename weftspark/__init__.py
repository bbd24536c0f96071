"""weftspark: relational data synthesis, checking and measurement as lazy Spark DataFrames."""

__version__ = "0.1.0"
