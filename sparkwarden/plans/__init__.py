"""Representative inputs over the driver tables and the registered queries."""
