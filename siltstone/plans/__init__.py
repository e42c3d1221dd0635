"""Registered queries and composed jobs, by subject."""

REGISTERED = ("search", "evidence", "texts", "events", "jobs", "details", "language", "structure")
