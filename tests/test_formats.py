import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siftstone.sources import formats


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_mail():
    data = b"Subject: =?utf-8?Q?Ol=C3=A1?= =?utf-8?B?IG11bmRv?=\r\nFrom: a@b\r\nContent-Type: multipart/alternative; boundary=\"x\"\r\n\r\n--x\r\nContent-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\ncaf=E9\r\n--x\r\nContent-Type: text/html\r\n\r\n<p>no</p>\r\n--x--\r\n"
    text, title = formats.mail_text(data)
    assert title == "Olá mundo" and "café" in text and "no" not in text.split("\n")


def test_rtf():
    text, title = formats.rtf_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}{\info{\title My title}}caf\'e9 \u8364?x\par next}")
    assert text == "café €x\nnext" and title == "My title"


def test_office_and_epub():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = archive(**{"word/document.xml": f'<w:document xmlns:w="{w}"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>', "docProps/core.xml": '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></c>'})
    assert formats.describe(docx, "docx") == ("one\ntwo\n", "T")
    slide = lambda t: f'<a:sld xmlns:a="x"><a:p><a:t>{t}</a:t></a:p></a:sld>'
    pptx = archive(**{f"ppt/slides/slide{k}.xml": slide(k) for k in (10, 2, 1)})
    assert formats.describe(pptx, "pptx")[0].split() == ["1", "2", "10"]
    epub = archive(**{"META-INF/container.xml": '<c xmlns="n"><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p xmlns="n"><title>B</title><manifest><item id="a" href="a%20b.html"/></manifest><spine><itemref idref="a"/></spine></p>', "o/a b.html": "<p>hi &amp; ho</p>"})
    assert formats.describe(epub, "epub") == ("\nhi & ho\n", "B")


@pytest.mark.parametrize("data,ext,want", [(b"a\0b", "txt", None), (b"", "txt", None), (b"caf\xc3\xa9", "md", "café"), (b"not a zip", "docx", None), (b"\xd0\xcf\x11\xe0", "doc", None), (b"{\\rtf1 hi}", "doc", "hi")])
def test_describe(data, ext, want):
    assert formats.describe(data, ext)[0] == want


def test_extract(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.zzz").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in formats.extract(files).collect()}
    assert got == {"a.txt": "hello", "b.zzz": None}


def test_sheets_and_pages():
    n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {n}><sheetData><row><c t="s"><v>1</v></c><c><v>42.5</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c><c t="str"><v>made</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>'
    xlsx = archive(**{"xl/sharedStrings.xml": f"<sst {n}><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet10.xml": sheet.replace("42.5", "10"), "xl/worksheets/sheet2.xml": sheet.replace("42.5", "2")})
    assert formats.describe(xlsx, "xlsx")[0].split() == ["bc", "42.5", "in", "made", "bc", "2", "in", "made", "bc", "10", "in", "made"]
    w = 'xmlns:w="w"'
    body = f"<w:document {w}><w:p><w:t>one</w:t><w:lastRenderedPageBreak/><w:t>two</w:t></w:p></w:document>"
    assert [p.strip() for p in formats.pages(archive(**{"word/document.xml": body}), "docx")] == ["one", "two"]
    assert formats.pages(archive(**{"word/document.xml": body.replace("<w:lastRenderedPageBreak/>", "")}), "docx") == []
    assert formats.percent_decoded("a%20b%C3%A9+%zz") == "a bé+%zz"


def test_prominent_lines():
    body = [("body text that goes on for long " * 5, 10.0)]
    assert formats.prominent([("A title", 20.0), ("of two lines", 20.1), *body, ("Part", 14.0)]) == ["A title of two lines", "Part"]
    assert formats.prominent([("One", 20.0), *body, ("Two", 20.0), *body, ("Three", 20.0)]) == []
    assert formats.prominent([]) == [] and formats.prominent(body) == []


def test_media():
    assert formats.media(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\1\0\0\0\0\x10") == {"kind": "image", "width": 256, "height": 16}
    assert formats.media(b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08\0\x20\0\x40") == {"kind": "image", "width": 64, "height": 32}
    wav = b"RIFF....WAVEfmt \x10\0\0\0\1\0\1\0" + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + b"\2\0\x10\0data" + (32000).to_bytes(4, "little")
    assert formats.media(wav) == {"kind": "audio", "seconds": 2.0}
    assert formats.media(b"text") == {} == formats.media(None)


def test_walk(spark, tmp_path):
    (tmp_path / "a/.hidden").mkdir(parents=True)
    (tmp_path / "a/.hidden/x.txt").write_text("x")
    (tmp_path / "a/README").write_text("plain words")
    (tmp_path / "a/bin").write_bytes(b"\0\1\2")
    got = formats.walk(spark, [str(tmp_path / "a"), str(tmp_path)])
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in got.select("path").collect()) == ["README", "bin"]
    texts = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in formats.extract(got, cap=5).collect()}
    assert texts == {"README": "plain", "bin": None}


def test_lines_set_as_titles(spark):
    w = 'xmlns:w="w"'
    docx = archive(**{"word/document.xml": f'<w:document {w}><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>A large</w:t></w:r><w:r><w:t> title</w:t></w:r></w:p><w:p><w:t>text</w:t></w:p></w:document>'})
    assert formats.title_lines(docx, "docx") == ["A large title"]
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="body"/></p:nvPr><a:t>no</a:t></p:sp><p:sp><p:nvPr><p:ph type="ctrTitle"/></p:nvPr><a:t>Slide title</a:t></p:sp></p:sld>'
    assert formats.title_lines(archive(**{"ppt/slides/slide1.xml": slide}), "pptx") == ["Slide title"]
    odt = archive(**{"content.xml": '<o xmlns:t="t"><t:h t:outline-level="1">Head</t:h><t:p t:style-name="Title">Top</t:p><t:p>x</t:p></o>'})
    assert formats.title_lines(odt, "odt") == ["Head", "Top"] and formats.title_lines(b"no", "odt") == [] == formats.title_lines(None, "docx")
    df = spark.createDataFrame([("/a.docx", bytearray(docx)), ("/b.gif", bytearray(b"GIF89a\x04\0\x05\0"))], "path string, content binary")
    assert {r["path"]: r["prominent"] for r in formats.extract(df).collect()} == {"/a.docx": ["A large title"], "/b.gif": []}
    assert {r["path"]: (r["kind"], r["width"], r["height"]) for r in formats.media_of(df).collect()} == {"/a.docx": (None, None, None), "/b.gif": ("image", 4, 5)}


def small_pdf(packed):
    """Two pages: one in plain codes, one whose font has a table; the tree of pages plain or in an object stream."""
    import zlib

    tree = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R] >>", 5: b"<< /Type /Font /Subtype /Type1 >>", 6: b"<< /Type /Font /ToUnicode 9 0 R >>"}
    one = rb"BT /F1 12 Tf 72 700 Td (Caf\351 \(one\)) Tj 0 -14 Td [(t) -20 (wo) -300 (three)] TJ ET"
    two = b"BT /F2 9 Tf <00010002> Tj T* <0003> Tj ET"
    table = b"beginbfchar <0001> <0041> endbfchar beginbfrange <0002> <0003> <0062> endbfrange"
    stream = lambda n, x, more=b"": b"%d 0 obj << /Length %d /Filter /FlateDecode %s >> stream\n%s\nendstream endobj\n" % (n, len(zlib.compress(x)), more, zlib.compress(x))
    out = b"%PDF-1.5\n" + b"".join(stream(n, x) for n, x in ((7, one), (8, two), (9, table)))
    if packed:
        heads, body = b"", b""
        for n, x in tree.items():
            heads += b"%d %d " % (n, len(body))
            body += x + b" "
        out += stream(20, heads + body, b"/Type /ObjStm /N %d /First %d" % (len(tree), len(heads)))
    else:
        out += b"".join(b"%d 0 obj %s endobj\n" % x for x in tree.items())
    return out + b"10 0 obj << /Title (A title) >> endobj\ntrailer << /Root 1 0 R /Info 10 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(spark, packed):
    data = small_pdf(packed)
    assert formats.describe(data, "pdf") == ("Café (one)\ntwo three\n\nAb\nc", "A title")
    assert formats.pages(data, "pdf") == ["Café (one)\ntwo three", "Ab\nc"]
    assert formats.describe(data.replace(b"/Root 1", b"/Encrypt 5 0 R /Root 1"), "pdf")[0] is None
    for cut in range(0, len(data), 37):
        formats.describe(data[:cut], "pdf")  # a broken file never ends the job
    df = spark.createDataFrame([("/a", bytearray(data))], "path string, content binary")
    assert formats.extract(df).first()["text"].startswith("Café")


def test_pages_with_accents(spark):
    """Accents fold away, but for whom they count; capitals never do."""
    df = spark.createDataFrame([(["The ración", "ON the", None, "the"],)], "ps array<string>")
    one = lambda **k: df.select(formats.pages_with(F.col("ps"), ["The", " ", "ON"], **k).alias("p")).first()["p"]
    assert one() == [1, 2] and one(accents=True) == [2]
