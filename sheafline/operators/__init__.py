"""Set-based operators on works, mentions, answers and entities."""
