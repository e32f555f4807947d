"""Ready-made rule sets and end-to-end plans."""
