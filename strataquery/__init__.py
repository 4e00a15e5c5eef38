"""strataquery: a Spark-first analytics engine for versioned entity catalogs."""
