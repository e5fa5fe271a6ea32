"""functions of quillspark."""
