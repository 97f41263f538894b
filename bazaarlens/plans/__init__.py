"""Composite queries: building the star schema and answering questions over it."""
