"""Landed payloads to postings, source configuration, contacts and stored tables."""
