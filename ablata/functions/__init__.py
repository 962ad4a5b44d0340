"""Column functions: keyed randomness, vectors, and statistics that stay defined where division by zero lurks."""
