"""Readers and writers: raw CSV files, the stored star schema, result files, generated tables."""
