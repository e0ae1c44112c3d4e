"""Training-data operators over a document table.

Nothing outside this subpackage imports it; the repository's entry module adds
its queries only when the subpackage is present.
"""
