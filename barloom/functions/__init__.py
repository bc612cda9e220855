"""Column helpers, guarded windows and distributed order statistics."""
