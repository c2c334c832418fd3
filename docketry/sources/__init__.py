"""Readers: column-mapped files, registry layouts, workbooks, registers, links."""
