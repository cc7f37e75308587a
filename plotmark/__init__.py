"""Property-records analytics as Spark DataFrame plans."""
