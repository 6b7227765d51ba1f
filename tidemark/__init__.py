"""tidemark: telemetry time-series analytics on Spark."""
