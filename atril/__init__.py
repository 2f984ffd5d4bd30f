"""Document retrieval and conversation analytics as Spark DataFrame operators."""
