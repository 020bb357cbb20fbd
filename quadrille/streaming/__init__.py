"""Quads that arrive as a stream."""
