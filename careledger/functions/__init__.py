"""Column and window builders shared by the operators."""
