"""Readers, page extractors and sinks."""
