"""DataFrame operators: joins with one-to-one resolution, candidates, trees, alignment, graphs, reports."""
