"""Change streams: debounce, folded lists, notices and resumable ingest."""
