"""Operators for training-data pipelines: counting, scanning, filtering, deduplicating, mixing and encoding text."""
