"""Operators on frames: scans of partitions, struct projection, merge."""
