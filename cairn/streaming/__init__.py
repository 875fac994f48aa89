"""Incremental runs over streams of artifacts."""
