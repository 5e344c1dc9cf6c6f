"""Folioscope operators."""
