"""Pure DataFrame operators."""
