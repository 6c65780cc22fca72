"""Complete queries over the star-schema tables, each with an independent SQL statement of its result."""
