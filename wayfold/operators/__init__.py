"""Operators over DataFrames: instance joins, graph-pattern matching, closures, model analysis, ontology building."""
