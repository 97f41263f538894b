"""Column expressions shared by the plans; all run on the JVM, inside generated code."""
