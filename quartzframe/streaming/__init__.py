"""streaming of quartzframe."""
