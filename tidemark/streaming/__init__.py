"""The same folds over streams."""
