"""Siltstone: document, vector, claim and event analytics as Spark DataFrame operators."""
