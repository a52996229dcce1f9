"""laminaflow: machine-log and telemetry analytics as Spark DataFrame jobs."""
