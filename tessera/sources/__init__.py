"""Readers, writers and generators of graphs."""
