"""Tables, the catalog and the registered queries."""
