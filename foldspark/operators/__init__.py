"""Operators over catalogs and light curves."""
