"""Page-level deduplication of binary snapshots, and training-data operators, on PySpark."""
