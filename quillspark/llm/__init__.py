"""Operators for large training-data pipelines, each built by one named
method; nothing else in the library imports this subpackage."""
