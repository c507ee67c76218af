"""Reusable plan shapes: ordered windows, quantiles, folds, iteration."""
