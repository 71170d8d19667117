"""Readers for dumps and pages, and versioned table output."""
