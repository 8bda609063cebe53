"""Density clustering and its building blocks as DataFrame plans."""
