"""Part of the rookery package."""
