"""Spark jobs for anomaly searches over long multi-detector recordings."""
