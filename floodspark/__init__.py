"""Flood-model run analytics as Spark DataFrame operators."""
