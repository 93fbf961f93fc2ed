"""Definitions against the catalog: conformance, planned updates, generated code."""
