"""Ad-performance analytics as Spark DataFrame operators."""
