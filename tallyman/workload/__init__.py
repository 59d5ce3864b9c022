"""The registered queries, each with an independent SQL formulation of the same result."""
