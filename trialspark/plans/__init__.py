"""Composite operators an analyst calls, and the registered queries."""
