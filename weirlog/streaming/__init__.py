"""Structured Streaming versions of cleaning, trends, KPIs and incident detection."""
