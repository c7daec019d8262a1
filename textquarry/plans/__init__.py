"""Plan helpers: size-checked joins, sums over hot groups, whole-index jobs."""
