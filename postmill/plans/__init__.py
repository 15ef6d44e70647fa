"""Whole jobs: collection, clean-up, scoring and digest over the stored tables."""
