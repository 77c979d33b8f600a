"""Tiny dumps, written as the real ones are: several bz2 streams in one file."""

import bz2
from pathlib import Path
from xml.sax.saxutils import escape


def page(title, text="", ns="0", redirect=False, raw_text=None, revisions=(), extra=""):
    body = raw_text if raw_text is not None else f'<text xml:space="preserve">{escape(text)}</text>'
    more = "".join(f"<revision><id>2</id><text>{escape(t)}</text></revision>" for t in revisions)
    return (
        f"  <page>\n    <title>{escape(title)}</title>\n    <ns>{ns}</ns>\n    <id>7</id>\n"
        f"{'    <redirect title=\"x\" />' if redirect else ''}"
        f"    <revision>\n      <id>1</id>\n      <contributor><username>u</username></contributor>\n"
        f"      {body}\n    </revision>{more}{extra}\n  </page>\n"
    )


def write(path: Path, pages, version="0.11", closed=True, per_stream=2, namespace=True, level=9):
    ns = f' xmlns="http://www.mediawiki.org/xml/export-{version}/"' if namespace else ""
    head = (
        f'<mediawiki{ns} version="{version}" xml:lang="en">\n'
        "  <siteinfo>\n    <sitename>S</sitename>\n    <namespaces><namespace key=\"0\" /></namespaces>\n  </siteinfo>\n"
    )
    chunks = [head]
    chunks += ["".join(pages[i : i + per_stream]) for i in range(0, len(pages), per_stream)]
    if closed:
        chunks.append("</mediawiki>\n")
    path.write_bytes(b"".join(bz2.compress(c.encode(), level) for c in chunks))
    return path
