"""Reusable relational operators: ordered scans, interval and radius joins."""
