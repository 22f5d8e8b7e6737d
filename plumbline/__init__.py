"""Plumbline: a Spark-native audit and data-quality engine.

Every operator is a function from DataFrames to a DataFrame.  Inputs are the
audited tables themselves, append-only snapshot tables that describe many
databases over many collection runs, and log streams.
"""
