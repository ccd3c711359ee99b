"""Sweeps that pick up where they stopped."""
