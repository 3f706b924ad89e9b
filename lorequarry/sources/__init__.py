"""Readers, writers and interfaces to outside services."""
