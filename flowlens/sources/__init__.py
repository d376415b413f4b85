"""Readers, writers and the flow view over the driver's event table."""
