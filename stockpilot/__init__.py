"""stockpilot: supply-planning decision tables as lazy Spark DataFrames."""

from stockpilot.params import DEFAULT, Params

__all__ = ["DEFAULT", "Params"]
