"""Regime analytics on Spark: bars, trailing features, neighbours, density clusters, validation."""
