"""Plan helpers shared by the operators: lineage cuts, bounded broadcasts, exact global ranks."""
