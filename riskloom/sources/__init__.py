"""Readers, catalogs and settings."""
