"""Column builders: canonical RDF terms and the SPARQL scalar functions."""
