"""Streams of crawl events."""
