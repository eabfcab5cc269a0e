"""Plans of the dossier engine."""
