"""DataFrame operators: blocking, graphs, scoring, consolidation, evaluation."""
