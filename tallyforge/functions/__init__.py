"""Column functions and labels."""
