"""Geospatial and text analytics as Spark jobs."""
