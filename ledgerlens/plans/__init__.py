"""Operators combined into jobs: normalise, serve, publish."""
