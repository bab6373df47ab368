"""Writers for finished feature tables."""
