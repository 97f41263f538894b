"""SQL statements that say, for another engine, what each registered query must return."""
