"""Column builders: rules, spans, rewriting, threats."""
