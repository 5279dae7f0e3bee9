"""The causal operators on streams: edges and cleaning, keyed by series."""
