"""Streaming of the dossier engine."""
