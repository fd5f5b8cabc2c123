"""Telemetry storage, search, correlation and corpus preparation on PySpark."""
