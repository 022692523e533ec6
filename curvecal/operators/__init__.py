"""DataFrame operators: grids, splits, moments, models, metrics."""
