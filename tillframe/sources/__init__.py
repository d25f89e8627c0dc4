"""Readers, writers, manifests and the shared folder for intermediate tables."""
