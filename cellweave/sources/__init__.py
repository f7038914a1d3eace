"""Readers and writers: tables, images, bundles, validation."""
