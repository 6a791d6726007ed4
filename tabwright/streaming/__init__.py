"""Fitted transforms and models on streams: they are projections, so a stream passes through them unchanged."""
