"""Spark jobs for road-traffic count tables."""
