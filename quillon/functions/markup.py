"""HTML as a stream of texts and tags, in time linear in the page, whatever it holds."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TO_END = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: Elements whose content is text up to their end tag; that of the first two isn't shown text.
RAW = ("script", "style", "title", "textarea")
_CLOSE = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, rest): `text` with its text, `open` and `close` with the tag's name and what stands in the tag.

    Comments, declarations and instructions are left out; so is a tag that the page's end cuts off.  What looks like a
    tag but has no name is text.  A quote that isn't closed doesn't hide the end of its tag.
    """
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "text", html.unescape(page[at:]), ""
            return
        if start > at:
            yield "text", html.unescape(page[at:start]), ""
        match = _NAME.match(page, start)
        if match is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start + 2)
                at = end + 1 if end >= 0 else size
            else:
                yield "text", "<", ""
                at = start + 1
            continue
        end = page.find(">", match.end())
        if end < 0:
            return
        inside = page[match.end() : end]
        if '"' in inside or "'" in inside:
            quoted = _TO_END.match(page, match.end())
            if quoted:
                end = quoted.end() - 1
                inside = page[match.end() : end]
        name, at = match[2].lower(), end + 1
        yield "close" if match[1] else "open", name, inside
        if name in _CLOSE and not match[1] and not inside.endswith("/"):
            close = _CLOSE[name].search(page, at)
            end = close.start() if close else size
            if name in ("title", "textarea"):
                yield "text", html.unescape(page[at:end]), ""
            at = end


def attributes(inside: str) -> dict[str, str]:
    """The attributes of a tag by their names in lower case; the first of equal names counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(inside):
        found.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value))
    return found
