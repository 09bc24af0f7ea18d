"""Operators on the text of messages and documents; nothing outside imports this package."""
