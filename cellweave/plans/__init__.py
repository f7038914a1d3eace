"""Explicit random plans and distributed row positions."""
