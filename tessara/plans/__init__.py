"""Named queries that apply the operators to tables."""
