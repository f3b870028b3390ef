"""A Spark-first analytics engine for typed property graphs and run-time traffic."""
