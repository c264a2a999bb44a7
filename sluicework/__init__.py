"""A Spark-first engine for curating text corpora and analysing learning logs."""
