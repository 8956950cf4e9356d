"""Plans, how they are run and watched, and the catalog of queries."""
