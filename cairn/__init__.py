"""Artifact analytics on Spark."""
