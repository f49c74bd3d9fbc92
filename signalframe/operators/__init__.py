"""Operators over point, detection, mask and signal tables."""
