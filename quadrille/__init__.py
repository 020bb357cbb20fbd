"""quadrille: RDF quads, SPARQL analytics and rule inference on Spark DataFrames."""
