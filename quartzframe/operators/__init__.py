"""operators of quartzframe."""
