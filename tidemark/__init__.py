"""Tidemark: time-alignment analytics and corpus operators on Spark."""
