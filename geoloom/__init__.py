"""Geometric time-series analytics on Spark."""
