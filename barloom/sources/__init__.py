"""Readers, normalisers, filters and report sinks."""
