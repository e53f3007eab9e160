"""Command line: ``convert`` a source, or look into a digest (``info``, ``toc``, ``list``, ``cat``, ``cover``)."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from dataclasses import dataclass
from pathlib import Path

from .api import App, Digest, info
from .sinks.export import preorder


@dataclass
class Config:
    """Settings from a JSON file; LAMELLA_* variables go first."""

    language: str | None = None
    capacity: int = 7

    @classmethod
    def load(cls, path: str | None = None, env=os.environ) -> Config:
        data = json.loads(Path(path).read_text()) if path else {}
        unknown = set(data) - {"language", "capacity"}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        c = cls(**data)
        c.language = env.get("LAMELLA_LANGUAGE", c.language)
        c.capacity = int(env.get("LAMELLA_CAPACITY", c.capacity))
        if c.capacity < 0:
            raise ValueError("capacity is negative")
        return c


def convert(source: str | None, target: str | None, kind: str | None, title: str | None, config: Config) -> None:
    app = App(language=config.language, capacity=config.capacity)
    if source is None:
        if sys.stdin.isatty():
            raise ValueError("no input")
        digest = app.digest_text(sys.stdin.read(), title)
    else:
        digest = app.digest_file(source)
    kind = kind or ({".epub": "epub", ".txt": "txt", ".md": "txt"}.get(Path(target).suffix.lower(), "archive") if target else "txt")
    if target is None:
        if kind != "txt":
            raise ValueError("only text goes to the standard output")
        with tempfile.NamedTemporaryFile() as f:
            digest.export_text(f.name)
            sys.stdout.write(Path(f.name).read_text())
    else:
        {"epub": digest.export_epub, "txt": digest.export_text, "archive": digest.save_as}[kind](target)


def look(command: str, path: str, serial: int | None) -> None:
    digest = Digest.open(path)
    if command == "info":
        print(info(digest))
    elif command == "toc":
        for depth, _, x in preorder(digest.toc()):
            print("  " * depth + x["title"] + (f" [{x['serialId']}]" if "serialId" in x else ""))
    elif command == "list":
        for s in digest.serials():
            print(f"{s['id']}\t{' / '.join(s['path'])}\t{s['fragments']} fragments")
    elif command == "cat":
        print(digest.summary(serial))
    else:
        cover = digest.cover()
        if not cover:
            raise ValueError("no cover")
        if sys.stdout.isatty():
            raise ValueError("a cover doesn't go to a terminal")
        sys.stdout.buffer.write(cover["bytes"])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lamella")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("source", nargs="?")
    c.add_argument("-o", "--output")
    c.add_argument("--format", choices=("txt", "epub", "archive"))
    c.add_argument("--title")
    c.add_argument("--config")
    for name in ("info", "toc", "list", "cat", "cover"):
        x = sub.add_parser(name)
        x.add_argument("path")
        if name == "cat":
            x.add_argument("serial", type=int)
    a = p.parse_args(argv)
    try:
        if a.command == "convert":
            convert(a.source, a.output, a.format, a.title, Config.load(a.config))
        else:
            look(a.command, a.path, getattr(a, "serial", None))
    except (ValueError, KeyError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
