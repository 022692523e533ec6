"""Readers, writers and layout changes for scans, wide tables and feature tables."""
