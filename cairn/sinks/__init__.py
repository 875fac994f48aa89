"""Sinks: manifests, canonical index, transactional file changes."""
