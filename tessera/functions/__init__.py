"""Column expressions (JVM-side, no Python UDFs)."""
