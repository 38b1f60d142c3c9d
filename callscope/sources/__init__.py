"""Readers and writers. Readers return lazy frames with explicit schemas."""
