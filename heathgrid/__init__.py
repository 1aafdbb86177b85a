"""Terrain, habitat-selection and spatial analytics as lazy Spark plans."""
