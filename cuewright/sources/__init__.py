"""Readers of landed payloads and writers of results; every reader gives a DataFrame with a fixed schema."""
