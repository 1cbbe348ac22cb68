"""Scans, sinks and the panels derived from the test tables."""
