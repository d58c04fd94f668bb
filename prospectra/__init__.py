"""Lead-intelligence analytics as Spark DataFrame operators."""
