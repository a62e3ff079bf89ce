"""Operators for preparing large-scale training corpora. Nothing else in the library imports this subpackage."""
