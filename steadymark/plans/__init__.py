"""Whole jobs: from images or vectors to the written result tables."""
