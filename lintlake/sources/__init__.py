"""Sources of units: files, diffs, git, generated corpora."""
