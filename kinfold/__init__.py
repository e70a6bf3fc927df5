"""Predictive analytics over relational tables, expressed as Spark plans."""
