"""Readers and writers for corpora, label sheets, lexicons and stage tables."""
