"""Whole flows (collect, enrich, resolve, verify, publish, report) composed from the operators."""
