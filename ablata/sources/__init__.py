"""Readers, writers and the table adapters."""
