"""Whole queries: searches, dashboard, reports."""
