"""Named queries over the given tables, and their SQL twins."""
