"""Readers of the cube's JSON documents and binary tables."""
