"""Readers, writers and fitted-table storage."""
