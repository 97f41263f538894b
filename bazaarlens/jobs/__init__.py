"""Command-line jobs; submit them with spark-submit or run them with ``python -m``."""
