"""Operators over long tables of points, voxels, neighbourhoods and edges."""
