"""DataFrame operators: joins, spelling, folds, metrics, blending and models."""
