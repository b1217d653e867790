"""Readers, writers and the two modelled views (sales, admissions)."""
