"""Column functions: text, URLs, evidence digests."""
