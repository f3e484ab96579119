"""Event and content analytics as Spark DataFrame operators."""
