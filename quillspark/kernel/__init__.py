"""kernel of quillspark."""
