"""End-to-end flows made of several operators."""
