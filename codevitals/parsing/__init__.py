"""Source text -> symbol rows, as Column expressions and window functions."""
