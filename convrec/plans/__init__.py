"""Query plans: stand-in inputs built from the driver tables and the registered queries."""
