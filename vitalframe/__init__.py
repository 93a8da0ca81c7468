"""vitalframe: clinical analytics as Spark DataFrame operators."""
