"""Operators for preparing training corpora: filtering, deduplication, mixing, tokenising.

One module per operator; ``queries.py`` registers the thin queries over the given tables.  Nothing else in the
library imports this subpackage.
"""
