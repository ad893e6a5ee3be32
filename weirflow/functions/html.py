"""Static HTML: a lenient tree, and paths into it."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

#: Elements that never have content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("html")
        self.open = [self.root]

    def _text(self, data: str) -> None:
        at = self.open[-1]
        if len(at):
            at[-1].tail = (at[-1].tail or "") + data
        else:
            at.text = (at.text or "") + data

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html" and len(self.open) == 1:
            self.root.attrib.update({k: v or "" for k, v in attrs})
            return
        e = ET.SubElement(self.open[-1], re.sub(r"[^\w.-]", "_", tag), {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.open) > 1:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        """Closes the innermost open element of that name and what is open within it; a tag that closes nothing is passed over."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self._text(data)


def parse(html: str) -> ET.Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def find(html: str | None, path: str) -> list[str]:
    """What a path finds, in document order: attributes for a path that ends in /@name, own text for /text(), else whole elements as
    markup. Steps, `//`, `*` and predicates are those of ElementTree's XPath."""
    if html is None:
        return []
    m = re.fullmatch(r"(.*?)(?:/@([\w:-]+)|/(text\(\)))?", path, re.S)
    steps = m[1]
    steps = f".{steps}" if steps.startswith("//") else "./" + steps.removeprefix("/html/").lstrip("/")
    found = parse(html).findall(steps)
    if m[2]:
        return [e.attrib[m[2]] for e in found if m[2] in e.attrib]
    if m[3]:
        return ["".join([e.text or "", *(c.tail or "" for c in e)]) for e in found]
    return [ET.tostring(e, encoding="unicode", method="html").removesuffix(e.tail or "") for e in found]
