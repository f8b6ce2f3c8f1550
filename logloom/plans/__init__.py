"""The registered queries and the flagship job."""
