"""Readers, writers, samplers and shared scratch storage."""
