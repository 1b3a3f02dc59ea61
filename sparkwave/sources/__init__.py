"""Readers and writers of recordings and EDF files."""
