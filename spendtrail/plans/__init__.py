"""Specs, simulated plans, reallocation and budget allocation."""
