"""Operators over message columns."""
