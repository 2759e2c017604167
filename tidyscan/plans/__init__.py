"""Plan shapes shared by the ordered operators."""
