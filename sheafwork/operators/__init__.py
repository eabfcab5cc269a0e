"""Operators of the dossier engine."""
