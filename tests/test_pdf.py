"""The PDF reader on files made here."""

import zlib

import pytest

from folioforge.sources import detect, pdf


def build(content, *, pack=True, extra="", font="<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>", page="", trailer="", more=b""):
    raw = zlib.compress(content) if pack else content
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 600 800]>>",
        3: f"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>{extra}>>{page}>>".encode(),
        4: b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(raw), b"/Filter/FlateDecode" if pack else b"", raw), 5: font.encode(),
    }
    body = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in objects.items()) + more
    return body + f"trailer <</Root 1 0 R{trailer}>>\nstartxref\n0\n%%EOF".encode()


CONTENT = b"BT /F1 10 Tf 100 700 Td (Hello world) Tj 0 -20 Td [(Wo) -50 (rd) -400 (gap)] TJ ET q 1 0 0 1 10 20 cm BT /F1 10 Tf 1 0 0 1 200 100 Tm (caf\\351 \\(x\\)) Tj ET Q"


def texts(raw):
    return [[(w[0], w[5]) for w in p.words] for p in pdf.read_pages(raw)]


def test_words_boxes_and_lines():
    (page,) = pdf.read_pages(build(CONTENT))
    assert [(w[0], w[5]) for w in page.words] == [("Hello", 0), ("world", 0), ("Word", 1), ("gap", 1), ("café", 2), ("(x)", 2)]
    assert (page.width, page.height) == (600, 800) and page.words[0][1] == 100 and page.words[0][4] == pytest.approx(101.2) and page.words[4][1] == 210
    assert texts(build(CONTENT, pack=False)) == texts(build(CONTENT)) and (pdf.read_pages(build(CONTENT, page="/Rotate 90"))[0].width) == 800


def test_differences_and_unicode_maps():
    font = "<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[65/eacute/fi 67/uni20AC]>>>>"
    assert texts(build(b"BT /F1 9 Tf (ABCD) Tj ET", font=font)) == [[("éﬁ€D", 0)]]
    cmap = b"begincodespacerange <0000> <ffff> endcodespacerange beginbfchar <0003> <00480069> endbfchar beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079>] endbfrange"
    more = b"6 0 obj <</Length %d>> stream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    font = "<</Type/Font/Subtype/Type0/ToUnicode 6 0 R/DescendantFonts[<</DW 500/W[3[600] 16 18 400]>>]>>"
    assert texts(build(b"BT /F1 9 Tf <0003001000120021> Tj ET", font=font, more=more)) == [[("Hiacy", 0)]]


def test_forms_and_inline_images():
    form = b"BT /F1 8 Tf 10 10 Td (inside) Tj ET"
    more = b"7 0 obj <</Subtype/Form/Matrix[1 0 0 1 5 5]/Length %d>> stream\n%s\nendstream endobj\n" % (len(form), form)
    assert texts(build(b"BI /W 1 ID \xff(x) Tj EI /X Do", extra="/XObject<</X 7 0 R>>", more=more)) == [[("inside", 0)]]


def test_filters():
    doc = pdf.Document(build(CONTENT))
    d = lambda name, raw, **p: doc.decode(pdf.Stream({"Filter": pdf.Name(name), "DecodeParms": {pdf.Name(k): v for k, v in p.items()}}, raw))
    assert d("ASCIIHexDecode", b"48 65 6>") == b"He`" and d("ASCII85Decode", b"<~87cURD]~>") == b"Hello" and d("RunLengthDecode", b"\x02abc\xfez\x80") == b"abczzz"
    assert d("LZWDecode", bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    assert d("FlateDecode", zlib.compress(b"\x02\x01\x02\x02\x01\x01"), Predictor=12, Columns=2) == b"\x01\x02\x02\x03"
    with pytest.raises(detect.Malformed, match="DCTDecode"):
        d("DCTDecode", b"")


def test_object_streams_and_broken_files():
    inner = b"5 0 <</Type/Font/Subtype/Type1/Encoding/MacRomanEncoding>>"
    more = b"9 0 obj <</Type/ObjStm/N 1/First 4/Length %d>> stream\n%s\nendstream endobj\n" % (len(inner), inner)
    raw = build(b"BT /F1 9 Tf (\x8e) Tj ET", more=more).replace(b"5 0 obj", b"8 0 obj", 1)
    assert texts(raw) == [[("é", 0)]]
    for bad, said in ((b"nothing", "header"), (build(CONTENT, trailer="/Encrypt 9 0 R"), "encrypted")):
        with pytest.raises(detect.Malformed, match=said):
            pdf.Document(bad)
    cyclic = build(CONTENT).replace(b"/Kids[3 0 R]", b"/Kids[2 0 R]")
    assert texts(cyclic) == [[("Hello", 0), ("world", 0), ("Word", 1), ("gap", 1), ("café", 2), ("(x)", 2)]]
    with pytest.raises(detect.LimitError):
        pdf.read_pages(build(b" " * 5000 + CONTENT), detect.Limits(stream=1000))
    assert texts(build(CONTENT)[:-300]) and pdf.Document(build(CONTENT, trailer="/Info 6 0 R", more=b"6 0 obj <</Title(T\\351)/Author<FEFF0041>>> endobj\n")).metadata() == {"Title": "Té", "Author": "A"}


def ink(content, **more):
    """Text and colour of every word, and the paper's colour."""
    (page,) = pdf.read_pages(build(content, **more))
    return [(w[0], w[6]) for w in page.words], page.paper.colour()


SHOW = b" BT /F1 9 Tf 50 50 Td (x) Tj ET"
FULL = b"0 0 600 800 re f"


@pytest.mark.parametrize(
    ("before", "colour", "paper"),
    [
        (b"", (0, 0, 0), (1, 1, 1)), (b"1 g", (1, 1, 1), (1, 1, 1)), (b"0 0 1 rg", (0, 0, 1), (1, 1, 1)), (b"0 1 1 0 k", (1, 0, 0), (1, 1, 1)), (b"/DeviceRGB cs 2 -1 0.5 sc", (1, 0, 0.5), (1, 1, 1)),
        (b"/Pattern cs /P1 scn", None, (1, 1, 1)), (b"[/Indexed /DeviceRGB 1 <000000ff8000>] pop /I cs 1 sc", (1, 128 / 255, 0), (1, 1, 1)), (b"/C cs 0.25 sc", (0.25,) * 3, (1, 1, 1)), (b"/S cs 1 scn", None, (1, 1, 1)),
        (b"0 g " + FULL + b" 1 g", (1, 1, 1), (0, 0, 0)), (b"0 g 0 0 600 400 re 0 400 600 400 re f 1 g", (1, 1, 1), (0, 0, 0)), (b"0 g " + FULL + b" 1 0 0 rg " + FULL, (1, 0, 0), (1, 0, 0)),
        (b"q 0 0 100 100 re W n 0 g " + FULL + b" Q 1 g", (1, 1, 1), (1, 1, 1)), (b"0.5 g 0 0 600 300 re f", (0.5,) * 3, (1, 1, 1)), (b"0.5 g 0 0 600 500 re f", (0.5,) * 3, None), (b"0 0 m 600 800 l 601 800 l f", (0, 0, 0), (1, 1, 1)),
        (b"300 0 m 600 400 l 300 800 l 0 400 l h f", (0, 0, 0), (1, 1, 1)), (b"q 600 0 0 800 0 0 cm /X Do Q", (0, 0, 0), None), (b"q 60 0 0 80 0 0 cm /X Do Q", (0, 0, 0), (1, 1, 1)), (b"/Pattern cs /P1 scn " + FULL + b" 0 g", (0, 0, 0), None),
        (b"/Sh sh", (0, 0, 0), None), (b"q 0.7 0.7 -0.7 0.7 0 0 cm " + FULL + b" Q", (0, 0, 0), None), (b"q 0.2 0.2 -0.2 0.2 300 0 cm " + FULL + b" Q", (0, 0, 0), (1, 1, 1)), (b"BT /F1 9 Tf (y) Tj ET " + FULL, (0, 0, 0), (1, 1, 1)), (b"q 1 g 0 0 300 800 re S Q", (0, 0, 0), (1, 1, 1)),
    ],
)
def test_colours(before, colour, paper):
    extra = "/ColorSpace<</I[/Indexed/DeviceRGB 1 <000000ff8000>]/C[/ICCBased 8 0 R]/S[/Separation/Spot/DeviceCMYK 8 0 R]>>/XObject<</X 7 0 R>>"
    more = b"7 0 obj <</Subtype/Image/Width 1/Height 1/Length 1>> stream\nx\nendstream endobj\n8 0 obj <</N 1/Length 1>> stream\nx\nendstream endobj\n"
    words, under = ink(before + SHOW, extra=extra, more=more)
    assert (words[-1][1] is None) == (colour is None) and words[-1][1] == (pytest.approx(colour) if colour else None) and under == (pytest.approx(paper) if paper else None)


def test_text_in_the_colour_of_the_paper(spark):
    from pyspark.sql import functions as F

    from folioforge.operators import normalise

    made = [b"1 g" + SHOW + b" 0 g" + SHOW, b"0.96 g" + SHOW, b"0.9 g" + SHOW, b"0 g " + FULL + SHOW, b"/Pattern cs /P1 scn" + SHOW]
    files = spark.createDataFrame([(k, bytearray(build(c))) for k, c in enumerate(made)], "doc_id long, content binary").withColumn("kind", F.lit("pdf"))
    got = normalise.background_findings(pdf.page_words(pdf.read_words(files)))
    assert sorted((r.doc_id, r.page, r.n) for r in got.collect()) == [(0, 1, 1), (1, 1, 1), (3, 1, 1)]
