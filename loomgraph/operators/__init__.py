"""Relational and graph operators over files, edges, tags and findings."""
