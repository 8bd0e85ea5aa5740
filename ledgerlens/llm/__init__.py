"""Operators of a training-data pipeline: ten numbered operators over documents and vectors."""
