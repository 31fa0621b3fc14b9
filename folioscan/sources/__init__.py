"""Where relations come from: files, live lookups, and the LaTeX-shaped tables derived from plain ones."""
