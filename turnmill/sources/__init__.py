"""Readers, writers and catalogue checks."""
