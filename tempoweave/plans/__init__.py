"""Plans composed of operators: range joins, and the pipelines of the command line."""
