"""Query language and whole plans: search, recent, sync."""
