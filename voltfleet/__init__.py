"""Telemetry of battery power stations on Spark."""
