"""Streams: tracking and dwell events with state, delayed release, the feed of new events, reconcile at write."""
