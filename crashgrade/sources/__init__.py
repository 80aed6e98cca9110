"""Readers, writers and the derived accident tables."""
