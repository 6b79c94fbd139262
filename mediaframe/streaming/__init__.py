"""The gap sessions, cells and onset folds over unbounded series."""
