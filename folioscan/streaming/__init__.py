"""Checks over files as they arrive."""
