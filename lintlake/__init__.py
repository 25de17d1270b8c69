"""Review Java and mapper XML sources as data: files, diffs, structure, rules and findings are DataFrames."""
