"""Column functions of byte strings and keys."""
