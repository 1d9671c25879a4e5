"""functions of quartzframe."""
