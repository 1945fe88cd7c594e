"""Plans that put operators together: reports, and the registry of queries."""
