"""DataFrame-to-DataFrame operators over ``transfers``; every graph is one ``case_id``."""
