"""Plan-level helpers: size-checked broadcast and plan inspection."""
