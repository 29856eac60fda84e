"""Jobs of several steps over code snippets, chat records and answers."""
