"""Spark-native graph analytics engine: graphs are pairs of DataFrames."""
