"""Sequence mapping and analytics as relational dataflow on Spark DataFrames."""
