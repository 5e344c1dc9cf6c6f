"""Folioscope streaming."""
