"""Spark-native analytics for timestamped recordings, frame trees, telemetry and dataflow graphs."""
