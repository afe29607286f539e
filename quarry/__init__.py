"""Quarry: approximate analytics and corpus preparation as plain Spark plans."""
