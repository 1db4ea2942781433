"""Readers, writers and table builders for crawl and corpus files."""
