"""Readers of log formats, the day-partitioned store, and a load generator."""
