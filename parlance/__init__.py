"""Matching, search, opinion mining and support analytics as Spark DataFrame operators."""
