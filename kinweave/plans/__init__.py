"""Multi-step plans and the registered queries."""
