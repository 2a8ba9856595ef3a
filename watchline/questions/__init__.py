"""A controlled question layer: fixed intents, each a parameterised query, and refusals."""
