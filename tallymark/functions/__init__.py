"""Column rules: each function maps Columns to a Column and stays inside the JVM."""
