"""Sources of the dossier engine."""
