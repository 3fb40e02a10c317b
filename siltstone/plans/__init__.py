"""siltstone.plans."""
