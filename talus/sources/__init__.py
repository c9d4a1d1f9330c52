"""Readers, replay and exchange formats."""
