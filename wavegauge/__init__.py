"""Telemetry monitoring operators expressed as Spark DataFrame transformations."""
