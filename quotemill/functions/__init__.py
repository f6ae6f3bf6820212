"""Column functions: text, metrics, judge replies."""
