"""Readers of feeds, sitemaps, robots files and pages, and sinks."""
