"""Column functions: number coercion, text rendering and parsing, exact statistics."""
