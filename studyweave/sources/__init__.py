"""Readers and writers: landed JSON, the parquet store, the test bridge."""
