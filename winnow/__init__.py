"""Scoring, triage and ranking of large candidate tables on Spark DataFrames."""

__version__ = "0.1.0"
