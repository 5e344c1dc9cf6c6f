"""Folioscope sources."""
