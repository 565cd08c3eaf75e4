"""Column expressions used by the jobs. All stay JVM-side except exact text similarity."""
