"""Held-out-group evaluation analytics as Spark DataFrame operators."""
