"""Folioscope functions."""
