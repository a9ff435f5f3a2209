"""Named queries over the corpus tables."""
