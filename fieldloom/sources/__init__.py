"""Scans with declared schemas, and checked writes."""
