"""Ledgers fed by streams."""
