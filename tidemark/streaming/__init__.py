"""Tidemark streaming."""
