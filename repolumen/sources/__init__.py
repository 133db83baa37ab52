"""Readers, writers and the schemas they agree on."""
