"""Functions of the dossier engine."""
