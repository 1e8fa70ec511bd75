"""Checks that the shared views agree between Spark and SQL."""
