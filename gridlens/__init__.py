"""Telemetry evidence engine and training-data operators on PySpark."""
