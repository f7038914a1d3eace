"""Censuses of seeds that arrive as a stream."""
