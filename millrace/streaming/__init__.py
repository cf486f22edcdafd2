"""Chunks that arrive as a stream keep the saved index up to date."""
