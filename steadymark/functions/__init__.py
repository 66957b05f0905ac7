"""Column functions over arrays: explanation metrics, corruptions, scores and curves."""
