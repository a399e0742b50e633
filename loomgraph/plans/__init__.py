"""Whole verbs: check, simulate, hotspots, recommend, put together from operators."""
