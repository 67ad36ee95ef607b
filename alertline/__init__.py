"""Alertline: score, rank and monitor rare events in transaction tables with PySpark."""
