"""Sources: driver tables, fixture views, message envelopes, catalog."""
