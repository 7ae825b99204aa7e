"""Readers and writers: raw log text, vocabularies, event adapter, outbox."""
