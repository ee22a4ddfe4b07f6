"""Evidence audit of labelling claims as DataFrame operators on Spark.

A *claim* says that a source assigns a subject (an identifier on a chain) to a
category.  The package normalises claim tables, traces each claim to the root of
its evidence, and measures how far sources corroborate, contradict or merely
repeat one another.  Every operator maps DataFrames to DataFrames.
"""
from .registry import Registry

__all__ = ["Registry"]
