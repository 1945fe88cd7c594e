"""Readers of content, manifests, records and sitemaps."""
