"""Reading and writing points, fields and constraint tables."""
