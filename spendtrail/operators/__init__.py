"""Journeys, credit, attribution, carryover filters, decomposition and diagnostics."""
