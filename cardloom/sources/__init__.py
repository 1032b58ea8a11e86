"""Readers of files and the domain views over the driver tables."""
