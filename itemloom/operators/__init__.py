"""DataFrame operators of the consolidation, exploration and merge jobs."""
