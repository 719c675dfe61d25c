"""Operators for preparing training text: scans, language, dedup, mixing and tokens."""
