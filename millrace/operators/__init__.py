"""Operators on tables of content, links, inventories and probes."""
