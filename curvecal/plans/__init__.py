"""User-level studies and the catalogue of registered queries."""
