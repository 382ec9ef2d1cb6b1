"""Catalog tables, nested-file ingest and ontology text."""
