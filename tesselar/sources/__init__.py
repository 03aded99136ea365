"""Reading and writing tensor files."""
