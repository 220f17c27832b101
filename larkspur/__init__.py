"""Listening-taste analytics as Spark jobs."""
