"""Loading and cleaning."""
