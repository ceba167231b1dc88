"""Evidence accumulation over event streams and tables, as DataFrame operators."""
