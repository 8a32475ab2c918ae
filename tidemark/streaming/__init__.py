"""Structured Streaming: the watermarked count and its sinks (flow), bounded
replays (replay), live ingest and audit poll (live), progress (progress)."""
