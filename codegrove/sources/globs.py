"""Path patterns with wildcards, as regular expressions that a scan can filter by."""

from __future__ import annotations

import re


def glob_pattern(glob: str) -> str:
    """A pattern that matches the paths a glob excludes.

    * and ? stop at slashes, ** crosses folders; a pattern without an inner slash holds at any depth, one that ends in a
    slash holds for what is below that folder.
    """
    below = glob.endswith("/")
    body = glob.strip("/")
    anchored = "/" in body or glob.startswith("/")
    out = ""
    for part in re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?)", body):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part).replace("\\/", "/"))
    return ("^" if anchored else "(?:^|/)") + out + ("/.*$" if below else "(?:/.*)?$")
