"""Operators on views, sources, tiles, pixels and voxels."""
