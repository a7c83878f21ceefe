"""Usage analytics for AI-assistant telemetry, expressed as Spark DataFrame jobs."""
