"""Operators over DataFrames of points, centers, constraints and grids."""
