"""Tests of queries without their data: one example row for each table, checks of types, golden SQL."""
