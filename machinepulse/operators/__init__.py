"""Operators over readings and verdicts, guide pages and messages."""
