"""Plain numpy algorithms, testable without Spark."""
