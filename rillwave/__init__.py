"""Windowed-signal analytics and corpus preparation as Spark DataFrame jobs."""
