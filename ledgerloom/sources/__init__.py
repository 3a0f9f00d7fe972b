"""Readers and writers: tables, statement files, rates and the keyed store."""
