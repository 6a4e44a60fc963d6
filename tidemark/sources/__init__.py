"""Where tables live and how rows get there."""
