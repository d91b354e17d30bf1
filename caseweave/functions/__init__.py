"""Column functions: identifiers, text spans, scoring."""
