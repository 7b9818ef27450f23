"""Tables, files and session plumbing."""
