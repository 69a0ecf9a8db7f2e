"""How tables depend on each other, projects and their settings, and the registered queries."""
