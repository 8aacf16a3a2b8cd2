"""Readers and writers of notes, feeds, exports and snapshots."""
