"""Column-level building blocks: scalars, window expressions, loss values."""
