"""Leadline: Spark jobs for ship soundings, from raw points to validated depth grids."""
