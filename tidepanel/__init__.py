"""Daily flow-panel analytics as Spark DataFrame operators."""
