"""Return-panel analytics on Spark: panels, folds, allocation kernels, back-tests, metrics, scoring and factors."""
