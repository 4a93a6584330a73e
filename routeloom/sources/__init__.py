"""Readers: files of transit data, and views over order tables."""
