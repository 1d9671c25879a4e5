"""quartzframe: a Spark-first analytics engine for machine-learning data work."""
