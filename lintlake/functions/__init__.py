"""Column functions: text positions, masks, paths, and small parsers of Java argument text."""
