"""Queries over the TPC-H-like test tables, seen through the member data model."""
