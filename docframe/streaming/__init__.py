"""Change streams, live queries and prefix watches on Structured Streaming."""
