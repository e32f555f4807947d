"""Readers, writers and file manifests."""
