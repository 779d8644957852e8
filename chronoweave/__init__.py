"""Bi-temporal knowledge engine expressed as Spark DataFrame plans."""
