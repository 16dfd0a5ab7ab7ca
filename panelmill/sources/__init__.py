"""Readers and writers of bars, universes, logs and ledgers."""
