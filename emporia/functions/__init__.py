"""Column helpers: statistics, geometry and calendar spines (all native)."""
