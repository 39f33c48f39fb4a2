"""Part of hazmill; see the modules."""
