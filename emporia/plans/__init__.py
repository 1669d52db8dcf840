"""Plans shared across analyses: order-grain bases and the SQL surface."""
