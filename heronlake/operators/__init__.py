"""Relational operators over the event, session and catalog tables."""
