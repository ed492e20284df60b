"""Results that combine several operators."""
