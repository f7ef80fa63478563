"""Readers that turn files or texts into traces, and writers of documented tables."""
