"""Civic-activity analytics as Spark DataFrame jobs."""
