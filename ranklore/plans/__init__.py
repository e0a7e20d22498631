"""Physical building blocks: shared work tables, distributed ranking, skew-safe lookups."""
