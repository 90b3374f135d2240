"""Compositions over the operators: rule packs and custom SQL
and analysis bundles (X4, A19, A20, A22, A23)."""
