"""Patterns, and what is planned from them on the driver before any data move."""
