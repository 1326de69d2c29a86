"""Readers and writers of panels, movement files, submissions and score payloads."""
