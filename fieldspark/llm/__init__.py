"""Operators of a training-data pipeline over text tables. Nothing else in the library imports this subpackage."""
