"""Beyond batch: progress of streams, and partitions filled as their rows arrive."""
