"""Operators: catalog, SQL, server information, records and event folds."""
