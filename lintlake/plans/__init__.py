"""Rules as queries over structure tables, and the plan of a review."""
