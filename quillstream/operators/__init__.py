"""Operators of the post pipeline, one family a module."""
