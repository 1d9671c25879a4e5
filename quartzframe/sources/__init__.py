"""sources of quartzframe."""
