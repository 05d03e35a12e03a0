"""Input tables, domain views, lookup tables and versioned snapshots."""
