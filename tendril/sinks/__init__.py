"""Reports as files: CSV, text summaries, markers of what was reported."""
