"""Code-intelligence analytics as Spark DataFrame plans."""
