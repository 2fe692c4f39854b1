"""Tidemark functions."""
