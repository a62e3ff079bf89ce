"""Readers for media folders, probes, frames and web pages, and the sinks that match them."""
