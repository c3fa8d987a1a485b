"""Column functions over hex words."""
