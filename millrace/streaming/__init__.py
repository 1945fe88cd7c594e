"""Streaming forms of the sign-up list and the append-only record log."""
