"""Relational operators over labelled panels."""
