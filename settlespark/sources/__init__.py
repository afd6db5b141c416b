"""Readers and writers for landed payloads and tables."""
