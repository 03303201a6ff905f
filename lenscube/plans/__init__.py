"""Query parameters and selections."""
