"""Jobs that are run from a command line: a function that takes a session, a config file, and a main."""
