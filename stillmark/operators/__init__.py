"""Operators on the catalogue, the frame index and duplicate graphs."""
