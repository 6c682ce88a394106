"""Column helpers and group-wise primitives shared by every operator."""
