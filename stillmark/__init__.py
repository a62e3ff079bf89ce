"""Perceptual media search on Spark: a catalogue, frame fingerprints, similarity search and duplicate groups as DataFrames."""
