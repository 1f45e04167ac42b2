"""Readers of models (tuple files, XMI) and ontologies (RDF/XML)."""
