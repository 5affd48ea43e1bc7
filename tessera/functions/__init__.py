"""Tessera package."""
