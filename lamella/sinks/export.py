"""A digest as plain text or as an EPUB 3 book (SNK1, SNK2, J8, G17)."""

from __future__ import annotations

import datetime
import uuid
import zipfile
from collections.abc import Callable, Iterator
from html import escape
from pathlib import Path

#: File types of covers.
IMAGES = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/gif": "gif", "image/svg+xml": "svg"}


def preorder(items: list[dict], depth: int = 0, path: tuple[str, ...] = ()) -> Iterator[tuple[int, tuple[str, ...], dict]]:
    """(depth, titles down to the item, item) in reading order."""
    for x in items:
        here = (*path, x["title"])
        yield depth, here, x
        yield from preorder(x["children"], depth + 1, here)


def plan(sections: list[dict], book_title: str | None = None) -> tuple[list[dict], list[tuple[int, dict]]]:
    """Table of contents with serial ids given parent first, and the sections in the order of work, children first. Sections without title get a number."""
    order: list[tuple[int, dict]] = []
    count = 0

    def visit(nodes: list[dict], prefix: tuple[int, ...]) -> list[dict]:
        nonlocal count
        out = []
        for i, n in enumerate(nodes, 1):
            at = (*prefix, i)
            alone = book_title if len(nodes) == 1 and not prefix else None
            item = {"title": (n.get("title") or "").strip() or (alone or "").strip() or f"Section {'.'.join(map(str, at))}"}
            if n.get("text") is not None:
                count += 1
                item["serialId"] = count
            item["children"] = visit(n["children"], at)
            if "serialId" in item:
                order.append((item["serialId"], n))
            out.append(item)
        return out

    return visit(sections, ()), order


def plain_text(items: list[dict], summary: Callable[[int], str | None]) -> str:
    parts = []
    for _, _, x in preorder(items):
        parts.append(x["title"].strip())
        if "serialId" in x:
            text = summary(x["serialId"])
            if text is None:
                raise ValueError(f"no summary of serial {x['serialId']}")
            parts.append(text.strip())
    whole = "\n\n".join(p for p in parts if p)
    return whole and whole + "\n"


def paragraphs(text: str) -> list[str]:
    import re

    return [p for p in (" ".join(b.split("\n")).strip() for b in re.split(r"\n\s*\n", text)) if p]


def _page(title: str, body: str, language: str) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="{escape(language)}"><head><title>{escape(title)}</title></head><body>{body}</body></html>\n'


def epub(path: str, meta: dict, items: list[dict], summary: Callable[[int], str | None], cover: dict | None = None, now: datetime.datetime | None = None) -> None:
    """Write the book; the type entry is first and stored, a digest without sections gets one page with its title."""
    language = (meta.get("language") or "").strip() or "und"
    title = meta.get("title") or "Untitled"
    pages = [(f"section-{x['serialId']}.xhtml", x["title"], summary(x["serialId"])) for _, _, x in preorder(items) if "serialId" in x]
    pages = pages or [("section-0.xhtml", title, "")]

    def links(nodes: list[dict]) -> str:
        out = ""
        for x in nodes:
            label = escape(x["title"])
            label = f'<a href="section-{x["serialId"]}.xhtml">{label}</a>' if "serialId" in x else f"<span>{label}</span>"
            out += f"<li>{label}{links(x['children'])}</li>"
        return f"<ol>{out}</ol>" if out else ""

    image = f"images/cover.{IMAGES.get(cover['mediaType'], 'bin')}" if cover else None
    manifest = ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>']
    spine = []
    if image:
        manifest += [f'<item id="cover-image" href="{image}" media-type="{escape(cover["mediaType"])}" properties="cover-image"/>', '<item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/>']
        spine.append('<itemref idref="cover"/>')
    for k, (name, _, _) in enumerate(pages):
        manifest.append(f'<item id="s{k}" href="{name}" media-type="application/xhtml+xml"/>')
        spine.append(f'<itemref idref="s{k}"/>')
    tag = lambda name, value: f"<dc:{name}>{escape(value)}</dc:{name}>" if value else ""
    modified = (now or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    opf = (
        '<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">{escape(meta.get("identifier") or f"urn:uuid:{uuid.uuid4()}")}</dc:identifier>{tag("title", title)}{tag("language", language)}{"".join(tag("creator", a) for a in meta.get("authors", []))}'
        f'{tag("publisher", meta.get("publisher"))}{tag("date", meta.get("publishedAt"))}{tag("description", meta.get("description"))}<meta property="dcterms:modified">{modified}</meta></metadata>'
        f"<manifest>{''.join(manifest)}</manifest><spine>{''.join(spine)}</spine></package>\n"
    )
    listed = links(items) or f'<ol><li><a href="section-0.xhtml">{escape(title)}</a></li></ol>'
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n')
        z.writestr("EPUB/package.opf", opf)
        z.writestr("EPUB/nav.xhtml", _page(title, f'<nav epub:type="toc"><h1>{escape(title)}</h1>{listed}</nav>', language))
        if image:
            z.writestr(f"EPUB/{image}", cover["bytes"])
            z.writestr("EPUB/cover.xhtml", _page("Cover", f'<img src="{image}" alt="Cover"/>', language))
        for name, head, text in pages:
            z.writestr(f"EPUB/{name}", _page(head, f"<section><h1>{escape(head)}</h1>{''.join(f'<p>{escape(p)}</p>' for p in paragraphs(text or ''))}</section>", language))
