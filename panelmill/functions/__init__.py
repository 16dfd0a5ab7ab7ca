"""Column helpers and group primitives shared by the operators."""
