"""Telemetry normalization on Spark: export payloads in, one flat row per log record, span or metric data point out."""
