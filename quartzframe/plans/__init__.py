"""plans of quartzframe."""
