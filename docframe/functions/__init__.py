"""Part of docframe."""
