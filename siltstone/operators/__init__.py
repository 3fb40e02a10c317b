"""siltstone.operators."""
