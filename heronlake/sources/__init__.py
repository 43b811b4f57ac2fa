"""Readers of transcripts and writers of derived files."""
