"""Whole reports assembled from the stages."""
