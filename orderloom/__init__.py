"""orderloom: retrieval, dialogue and catalog analytics as Spark DataFrame plans."""
