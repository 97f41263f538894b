"""Sales analytics over a marketplace star schema, as plain Spark DataFrame functions."""

__version__ = "0.1.0"
