"""The query language: grammar, binding to a model, patterns and text forms. Driver-side; works on metadata only."""
