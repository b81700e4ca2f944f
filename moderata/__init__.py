"""Moderata: text-moderation datasets, scoring, evaluation and feedback on Spark.

Everything is a function from DataFrames (or Columns) to DataFrames (or
Columns), so Catalyst sees one declarative plan per job.
"""
