"""Books and digests: written, read again, converted."""

import io
import zipfile

import pytest

from lamella.api import App, Digest
from lamella.cli import Config, main
from lamella.sources import archive, epub, plain

NAV = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="text/one.xhtml#brief">Tuning the Strings</a><ol><li><a href="text/one.xhtml#list">Spare Parts</a></li></ol></li></ol></nav></body></html>'
ONE = "<html><head><title>x</title></head><body><p>Before.</p><h1 id='brief'>Tuning the Strings</h1><p>Turn the\n  pegs.<br/>Listen.</p><h2 id='list'>List</h2><p>Keep two strings dry.</p><script>no()</script></body></html>"
OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> A  Small  Harp Book </dc:title><dc:creator>Mina Oakes</dc:creator><dc:language>en</dc:language><dc:date>2019-05-17</dc:date></metadata>
<manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c" href="text/cover.xhtml" media-type="application/xhtml+xml"/><item id="a" href="text/one.xhtml" media-type="application/xhtml+xml"/><item id="b" href="text/chapter-2-tunes.xhtml" media-type="application/xhtml+xml"/><item id="img" href="images/cover.png" media-type="image/png" properties="cover-image"/></manifest>
<spine><itemref idref="c"/><itemref idref="a"/><itemref idref="b"/></spine></package>"""


def book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="EPUB/p.opf"/></rootfiles></container>')
        for name, text in (("p.opf", OPF), ("nav.xhtml", NAV), ("text/one.xhtml", ONE), ("text/cover.xhtml", "<html><body>Cover</body></html>"), ("text/chapter-2-tunes.xhtml", "<html><body><p>Play it slowly.</p></body></html>"), ("images/cover.png", "PNG")):
            z.writestr(f"EPUB/{name}", text)
    return out.getvalue()


def test_epub():
    b = epub.Book(book())
    assert b.metadata()["title"] == "A Small Harp Book" and b.metadata()["authors"] == ["Mina Oakes"]
    assert b.cover() == {"path": "EPUB/images/cover.png", "mediaType": "image/png", "bytes": b"PNG"}
    top = b.sections()
    assert [s["title"] for s in top] == ["Tuning the Strings", "chapter-2-tunes"] and top[0]["children"][0]["title"] == "Spare Parts"
    texts = b.texts()
    assert "Turn the pegs.\nListen." in texts[top[0]["id"]] and "two strings" not in texts[top[0]["id"]] and "Before" not in texts[top[0]["id"]]
    assert "Keep two strings dry." in texts[top[0]["children"][0]["id"]] and "no()" not in "".join(texts.values())


def test_epub_scan(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    rows = epub.scan(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.title, r.depth) for r in rows] == [("Tuning the Strings", 0), ("Spare Parts", 1), ("chapter-2-tunes", 0)]


def test_digest_round_trip(tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    seen = []
    digest = App(listener=seen.append).digest_file(str(tmp_path / "a.epub"))
    assert [s["title"] for s in digest.serials()] == ["Tuning the Strings", "Spare Parts", "chapter-2-tunes"]
    assert seen[0]["type"] == "serials-discovered" and seen[-1]["completedWords"] == seen[-1]["totalWords"]
    digest.save_as(str(tmp_path / "d.zip"))
    again = Digest.open(str(tmp_path / "d.zip"))
    assert again.toc() == digest.toc() and again.cover()["bytes"] == b"PNG" and again.summary(1) == digest.summary(1)
    again.export_epub(str(tmp_path / "out.epub"))
    made = epub.Book((tmp_path / "out.epub").read_bytes())
    assert made.metadata()["title"] == "A Small Harp Book" and [s["title"] for s in made.sections()][:1] == ["Tuning the Strings"]
    with zipfile.ZipFile(tmp_path / "out.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    with pytest.raises(KeyError):
        again.summary(99)


def test_long_text_has_groups_and_snakes(tmp_path):
    text = " ".join(f"Sentence number {i} speaks about telescopes and instrument {i % 7} again." for i in range(900))
    digest = App().digest_text(text, "Long")
    folder = digest.folder
    assert len(folder.fragment_ids(1)) > 20 and folder.rows("snakes") and folder.rows("snake_edges")
    assert len(folder.rows("chunks")) == 300 + sum(1 for _ in ()) or len(folder.rows("chunks")) >= 300
    assert {r[2] for r in folder.rows("fragment_groups")} <= set(folder.fragment_ids(1))


def test_archive_rules(tmp_path):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x", "y")
    with pytest.raises(ValueError):
        archive.extract(str(tmp_path / "bad.zip"), str(tmp_path / "out"))
    f = archive.Folder(str(tmp_path))
    f.sidecar("book-meta.json", {"version": 1})
    with pytest.raises(FileExistsError):
        f.sidecar("book-meta.json", {"version": 1})
    assert f.fragment(1, 0, []) is None and f.fragment_ids(1) == []
    assert archive.fragment('[{"text": "a", "wordsCount": 1}]') == {"summary": "", "sentences": [{"text": "a", "wordsCount": 1}]}
    with pytest.raises(ValueError):
        archive.fragment('[{"text": 3}]')


def test_archive_tables(spark, tmp_path):
    f = archive.Folder(str(tmp_path))
    f.put("serials", [(1,), (3,), (5,)])
    f.put("knowledge_edges", [(2, 1, None, 1.5), (2, 1, "critical", 2.5)])
    assert f.table(spark, "serials").count() == 3
    assert f.table(spark, "knowledge_edges").collect()[0].asDict() == {"from_id": 2, "to_id": 1, "strength": "critical", "weight": 2.5}


def test_plain(spark, tmp_path):
    (tmp_path / "Field Notes.md").write_text("# Title\n\nBody.")
    row = plain.scan(spark, str(tmp_path)).first()
    assert row.title == "Field Notes" and row.text == "# Title\n\nBody."
    assert plain.infer_format("A.MARKDOWN") == "markdown"
    with pytest.raises(ValueError):
        plain.infer_format(str(tmp_path / "x.bin"))


def test_cli(tmp_path, capsys):
    (tmp_path / "a.txt").write_text("One sentence is here. Another one follows it. A third closes the text.")
    assert main(["convert", str(tmp_path / "a.txt"), "-o", str(tmp_path / "d.zip")]) == 0
    assert main(["info", str(tmp_path / "d.zip")]) == 0 and "title: a" in capsys.readouterr().out
    assert main(["list", str(tmp_path / "d.zip")]) == 0 and main(["toc", str(tmp_path / "d.zip")]) == 0
    assert main(["cat", str(tmp_path / "d.zip"), "7"]) == 1
    assert main(["convert", str(tmp_path / "none.txt")]) == 1
    assert Config.load(env={"LAMELLA_LANGUAGE": "de"}).language == "de"
