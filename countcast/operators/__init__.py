"""Single steps: profiling, filtering, rollups, features, splits, grids, metrics."""
