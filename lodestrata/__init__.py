"""lodestrata: a Spark-first engine for versioned key-value change logs and mergeable sketches."""
