"""Ordered operators: row index, halo windows, lags, rolling, sequences, detectors, models."""
