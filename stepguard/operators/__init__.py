"""DataFrame operators: rules, adjacency, profiles, splits, sampling, evaluation."""
