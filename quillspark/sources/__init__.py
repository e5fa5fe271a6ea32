"""sources of quillspark."""
