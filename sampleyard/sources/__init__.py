"""Catalog tables, audio files, configuration and errors."""
