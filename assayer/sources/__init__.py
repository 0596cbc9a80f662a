"""Reading files, registering tables, read-only SQL, record output and prepared bundles."""
