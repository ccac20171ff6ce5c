"""Match analytics as Spark DataFrame operators."""
