"""Whole analyses: the pipeline, registered queries and their SQL."""
