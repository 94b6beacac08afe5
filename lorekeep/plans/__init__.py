"""Driver-side planning: from patterns and queries to columns."""
