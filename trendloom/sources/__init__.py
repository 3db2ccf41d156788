"""Scans of landed raw items, their normalisation, and table sinks."""
