"""Query plans over the fixture tables, and their registry."""
