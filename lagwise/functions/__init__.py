"""Column functions and aggregates: statistics, ranks, correlation, scaling, metrics."""
