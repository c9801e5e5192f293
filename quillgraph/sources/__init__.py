"""Table, file and QA sources."""
