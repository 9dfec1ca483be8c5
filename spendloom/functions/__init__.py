"""Column functions and grouped statistics."""
