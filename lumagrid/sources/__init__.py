"""Reading and writing images."""
