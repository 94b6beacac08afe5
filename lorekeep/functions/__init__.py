"""Scalar building blocks: text keys, statistics, world time, vectors."""
