"""DataFrame operators: merges, folds, materialisation, retention."""
