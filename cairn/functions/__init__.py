"""Column functions: vectors, text, chunking, embedding."""
