"""Column functions: RDF terms, lexical forms and IRIs."""
