"""Document and compliance analytics as Spark DataFrame operators."""
