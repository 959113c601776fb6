"""Reading and writing tables, configurations and models."""
