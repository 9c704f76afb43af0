"""Tables and the roles they play."""
