"""Training-data operators: sharding, quality, PII, decontamination, near and exact
dedup, token stores, language ID, licence scans and packing.

Nothing outside this subpackage imports it.
"""
