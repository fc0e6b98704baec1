"""Part of pathweave."""
