"""Readers, writers, the custom history source and the keyed call store."""
