"""Operators of a training-data pipeline: filtering, scoring, formatting, deduplication and tokenising on Spark.

Nothing else in the package imports this subpackage. Its registered queries are in ``queries``.
"""
