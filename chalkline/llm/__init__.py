"""Operators for training data over text. Nothing else in the library imports this subpackage."""
