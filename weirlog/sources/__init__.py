"""Readers, tables and generators of request logs."""
