"""Vessel performance and passage analytics on Spark."""
