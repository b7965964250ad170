"""Evidence work on Spark: segment, type, search, resolve, compute and verify at corpus scale."""
