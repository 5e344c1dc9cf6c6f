"""Folioscope plans."""
