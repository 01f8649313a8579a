"""Query plans: registered queries and end-to-end flows."""
