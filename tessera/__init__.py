"""Part of the episode analytics engine."""
