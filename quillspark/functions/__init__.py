"""Functions: SQL, Python and table functions, and the hash of hashed partitions."""
