"""Query generation: attribute lattices and jobs over many sub-tables."""
