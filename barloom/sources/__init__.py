"""Readers, writers and the adapters over the star-schema test tables."""
