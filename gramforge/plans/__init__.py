"""AND/OR plans of regular expressions, cutting of lineage."""
