"""Named queries and the whole pipeline."""
