"""Seeded look-alike tables and imported hyper-parameters."""
