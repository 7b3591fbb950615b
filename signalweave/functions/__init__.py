"""Column functions: strings, identifiers, dates, vectors, hashes."""
