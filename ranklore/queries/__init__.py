"""Registered queries, one module a family; importing a module registers its queries."""
