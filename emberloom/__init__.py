"""emberloom: retrieval, near-duplicate, theme and telemetry analytics as Spark DataFrame operators."""
