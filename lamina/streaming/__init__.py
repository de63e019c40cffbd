"""Extension: chunked writing with Structured Streaming."""
