"""Versioned key-value analytics on Spark: record logs, sorted runs, sketches, integrity."""
