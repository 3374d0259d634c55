"""Readers, writers, sweep files and the shared checkpoint store."""
