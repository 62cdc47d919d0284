"""Telemetry records as a stream."""
