"""Dose-volume analytics and plan tables as Spark DataFrame jobs."""
