"""Prediction-quality sweeps over training rows (N) and predictors (K) on Spark."""
