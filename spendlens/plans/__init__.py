"""Analytical questions. Each takes wide campaign rows (``Star.facts`` or a stored master)."""
