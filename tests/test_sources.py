"""Detection, office and OCR readers on documents made here."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.operators import hooks, layout, providers
from folioforge.sources import detect, ocr, office


def box(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


WNS, XNS = office.W.strip(), office.X.strip()
BODY = f"""<w:document xmlns:w="{WNS}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>
<w:p><w:pPr><w:t>no</w:t></w:pPr><w:r><w:t>Hello </w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>world</w:t><w:tab/><w:t>x</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><mc:AlternateContent><mc:Choice><w:r><w:t>first</w:t></w:r></mc:Choice><mc:Fallback><w:r><w:t>second</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p></w:body></w:document>"""
DOCX = box({"[Content_Types].xml": "wordprocessingml.document", "word/document.xml": BODY, "word/header1.xml": f'<w:hdr xmlns:w="{WNS}"><w:t>top</w:t></w:hdr>'})
SHEET = f'<worksheet xmlns="{XNS}"><sheetData><row><c r="B1" t="s"><v>1</v></c><c r="A1"><v>44927</v></c></row><row><c r="A2" t="b"><v>1</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c><c t="s"><v>9</v></c></row></sheetData></worksheet>'
XLSX = box({"xl/workbook.xml": f'<workbook xmlns="{XNS}"/>', "xl/worksheets/sheet2.xml": SHEET, "xl/worksheets/sheet10.xml": SHEET, "xl/sharedStrings.xml": f'<sst xmlns="{XNS}"><si><t>zero</t></si><si><r><t>on</t></r><r><t>e</t></r></si></sst>'})
CSV = b'\xef\xbb\xbfa,"b ""q"", c"\r\n1,\r\n\r\nx,y,z\n'


def test_office_words():
    words, hidden, skipped = office.read_docx(DOCX)
    assert [(t, line) for _, _, t, line in words.rows] == [("Hello world\tx", 1), ("a", 2), ("b", 2), ("first", 3)] and hidden == 1 and skipped == ["word/header1.xml"]
    assert [(p, t, line) for p, _, t, line in office.read_xlsx(XLSX).rows] == [(1, "44927", 1), (1, "one", 1), (1, "TRUE", 2), (1, "in", 2), (2, "44927", 3), (2, "one", 3), (2, "TRUE", 4), (2, "in", 4)]
    assert [(t, line) for _, _, t, line in office.read_csv(CSV).rows] == [("a", 1), ('b "q", c', 1), ("1", 2), ("x", 3), ("y", 3), ("z", 3)]


@pytest.mark.parametrize("text", ['a,b"c', '"a"b,c', '"open'])
def test_strict_quotes(text):
    with pytest.raises(detect.Malformed):
        detect.strict_csv(text)


def test_hostile_containers():
    small = detect.Limits(stream=1000).normalised()
    with pytest.raises(detect.LimitError, match="max_stream"):
        office.read_docx(box({"word/document.xml": b"<a>" + b" " * 5000 + b"</a>"}), small)
    for bad in (b"PK\x03\x04junk", DOCX[:200], box({"word/document.xml": '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'}), box({"other": "x"})):
        with pytest.raises(detect.Malformed):
            office.read_docx(bad)
    with pytest.raises(detect.LimitError):
        office.read_docx(box({"word/document.xml": "<a>" * 400 + "</a>" * 400}))
    with pytest.raises(detect.LimitError):
        detect.check_pixels(1 << 20, 1 << 20)
    assert detect.image_size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x05\0\0\0\x07") == (5, 7) and detect.Limits(pages=0).normalised().pages == 1000


def test_identify_and_read(spark, tmp_path):
    files = {"a.bin": DOCX, "b.bin": XLSX, "c.bin": b"h,i\n1,2\n", "d.bin": b"junk %PDF-1.4 trailer <</Encrypt 5 0 R>>", "e.bin": b"\x89PNG\r\n\x1a\n....", "f.bin": b"just text", "g.bin": b"x" * 5000, "h.bin": b"PK\x03\x04broken", "i.bin": b"%PDF-1.7 ok"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    found = detect.identify(detect.read_files(spark, str(tmp_path), detect.Limits(source=4000))).cache()
    got = {r.path[-5]: (r.kind, r.pages, r.error and r.error[:31]) for r in found.collect()}
    assert got == {"a": ("docx", 0, None), "b": ("xlsx", 0, None), "c": ("csv", 0, None), "d": ("pdf", 0, "encrypted"), "e": ("png", 1, None), "f": (None, 0, "unsupported"), "g": (None, 0, "the document exceeds the source"), "h": (None, 0, "malformed"), "i": ("pdf", 0, None)}
    words = office.read_words(found)
    assert words.filter("error is null").count() == 4 + 8 + 4


def test_textract(spark):
    b = lambda i, kind, text=None, top=0.1, left=0.0, kids=(): {"Id": i, "BlockType": kind, "Text": text, "Confidence": 90.0, "Page": 1, "Geometry": {"BoundingBox": {"Left": left, "Top": top, "Width": 0.1, "Height": 0.01}}, "Relationships": [{"Type": "CHILD", "Ids": list(kids)}]}
    reply = json.dumps({"Blocks": [b("l1", "LINE", kids=("w2", "w1")), b("w1", "WORD", "one", left=0.1), b("w2", "WORD", "two", left=0.5), b("w3", "WORD", "lone", top=0.9)]})
    rows = ocr.textract_words(spark.createDataFrame([(1, reply)], "doc_id long, reply string"), 600, 800).orderBy("order").collect()
    assert [(r.text, r.line, r.conf) for r in rows] == [("one", 1, 0.9), ("two", 1, 0.9), ("lone", 2, 0.9)] and rows[0].minx == 60


def test_google_azure_hocr(spark):
    v = lambda *p: [{"x": x, "y": y} for x, y in p]
    g = {"pages": [{"width": 300, "height": 600, "confidence": 0.5, "blocks": [{"paragraphs": [{"words": [{"boundingBox": {"vertices": v((10, 20), (50, 40))}, "symbols": [{"text": "H"}, {"text": "i"}]}, {"confidence": 0.9, "boundingBox": {"normalizedVertices": v((0.5, 0.5), (1, 1))}, "symbols": [{"text": "x"}]}]}]}]}]}
    rows = ocr.google_words(spark.createDataFrame([(1, json.dumps(g))], "doc_id long, reply string"), 72).orderBy("i").collect()
    assert [(r.text, r.conf, r.minx, r.maxy) for r in rows] == [("Hi", 0.5, 10.0, 40.0), ("x", 0.9, 150.0, 600.0)]
    a = {"pages": [{"pageNumber": 1, "width": 8, "height": 11, "words": [{"content": "w", "confidence": 0.7, "polygon": [1, 1, 2, 1, 2, 2, 1, 2], "span": {"offset": 5, "length": 1}}, {"content": "z", "confidence": 0.6, "polygon": [1, 1, 2, 1, 2, 2, 1, 2], "span": {"offset": 50, "length": 1}}], "lines": [{"content": "w", "spans": [{"offset": 4, "length": 3}]}]}]}
    rows = ocr.azure_words(spark.createDataFrame([(1, json.dumps(a))], "doc_id long, reply string")).orderBy("i").collect()
    assert [(r.text, r.line, r.minx, r.maxy) for r in rows] == [("w", 0, 72.0, 144.0), ("z", 2, 72.0, 144.0)]
    h = '<div class="ocr_page"><span class="ocr_line"><span class="ocrx_word" title="bbox 0 0 300 150; x_wconf 80">Hé<em>llo</em></span> <span class="ocrx_word" title="bbox 1 2 3 4">&amp;</span></span></div>'
    rows = ocr.hocr_words(spark.createDataFrame([(1, h), (2, None)], "doc_id long, reply string")).collect()
    assert [(r.text, r.conf, r.maxx, r.line) for r in rows] == [("Héllo", 0.8, 72.0, 0), ("&", 0.8, 0.72, 0)]
    assert ocr.classify_error(429) == "rate_limited" and ocr.classify_error(503) == "unavailable"


def test_tables(spark):
    cells = [("t", 1, 0, 0, "header", "A|b", 1, 2, 0.9, 1), ("t", 1, 1, 0, "data", "c", 1, 1, 0.9, 2), ("t", 1, 1, 1, "data", "d\ne", 0, 0, 0.9, 3), ("u", 1, 0, 0, "data", "x", 2, 1, 0.9, 1), ("u", 1, 1, 0, "data", "y", 1, 1, 1.5, 2)]
    df = spark.createDataFrame(cells, "table_id string, page int, row int, col int, kind string, text string, row_span int, col_span int, conf double, seq int")
    assert {tuple(r) for r in layout.check_tables(df).collect()} == {("u", "cells overlap"), ("u", "confidence outside 0 to 1")}
    assert {r.table_id: r.markdown for r in layout.markdown(df).collect()}["t"] == "| A\\|b |  |\n| --- | --- |\n| c | d e |"


def test_chain_and_breaker(spark):
    now, calls = [0.0], []

    def broken(_):
        calls.append(1)
        raise providers.ProviderError("unavailable")

    b = providers.Breaker(broken, failures=2, cooldown=10, clock=lambda: now[0])
    assert providers.chained([b, lambda r: r + "!"])("x") == "x!" and providers.chained([b, lambda r: r])("y") == "y"
    with pytest.raises(providers.ProviderError, match="open"):
        b("z")
    now[0] = 11.0
    with pytest.raises(providers.ProviderError):
        b("z")
    assert len(calls) == 3

    def refused(_):
        raise providers.ProviderError("auth")

    with pytest.raises(providers.ProviderError, match="auth"):
        providers.chained([refused, lambda r: r])("x")
    rows = providers.generate(spark.createDataFrame([(1, "a"), (2, "boom"), (3, "")], "doc_id long, request string"), lambda r: json.dumps({"v": 1 // (len(r) % 4)}) if r else "", 2).collect()
    assert {r.doc_id: (r.reply, r.error) for r in rows} == {1: ('{"v": 1}', None), 2: (None, "internal"), 3: (None, "bad_response")}


def test_google_lines(spark):
    v = lambda x: {"vertices": [{"x": x, "y": 0}, {"x": x + 5, "y": 5}]}
    word = lambda t, x, stop=None, own=None: {"boundingBox": v(x), "symbols": [{"text": c, **({"property": {"detectedBreak": {"type": stop}}} if stop and c is t[-1] else {})} for c in t], **({"property": {"detectedBreak": {"type": own}}} if own else {})}
    g = {"pages": [{"width": 99, "height": 99, "confidence": 1, "blocks": [{"paragraphs": [{"words": [word("b", 20, "SPACE"), word("a", 10, "LINE_BREAK"), word("c", 0, "HYPHEN"), word("d", 30, own="EOL_SURE_SPACE")]}, {"words": [word("e", 0), {"boundingBox": v(9)}]}]}]}]}
    rows = ocr.google_words(spark.createDataFrame([(1, json.dumps(g)), (2, None)], "doc_id long, reply string"), 72).orderBy("order").collect()
    assert [(r.text, r.line, r.joined) for r in rows] == [("a", 0, False), ("b", 0, False), ("c", 1, True), ("d", 1, False), ("e", 2, False)]


def test_azure_centres_and_replies(spark):
    box = lambda x, y, w=1, h=1: [x, y, x + w, y, x + w, y + h, x, y + h]
    a = {"pages": [{"pageNumber": 1, "unit": "inch", "words": [{"content": c, "polygon": box(*at), "span": {"offset": 90, "length": 1}} for c, at in (("in", (2, 5)), ("out", (7, 9)))], "lines": [{"content": "x", "polygon": box(0, 0, 9, 1), "spans": []}, {"content": "y", "polygon": box(0, 4.8, 9, 1.4), "spans": []}]}]}
    df = spark.createDataFrame([(1, json.dumps(a), 1), (2, json.dumps(a), 2), (3, json.dumps(a).replace("inch", "pixel"), 1), (4, "no", 1)], "doc_id long, reply string, pages int")
    assert [(r.text, r.line) for r in ocr.azure_words(df.filter("doc_id = 1")).orderBy("i").collect()] == [("in", 1), ("out", 3)]
    assert {tuple(r) for r in ocr.azure_problems(df).collect()} == {(2, "bad_response"), (3, "unsupported"), (4, "bad_response")}


def test_whole_documents_are_refused_rather_than_read_in_part(spark):
    rows = [("pdf", 5, 9), ("pdf", 6, 9), ("tiff", 1, 9), ("pdf", 1, 0)]
    df = spark.createDataFrame(rows, "kind string, pages int, size int")
    said = lambda service, **more: [r.e for r in df.select(ocr.refused(service, F.col("kind"), F.col("pages"), F.col("size"), **more).alias("e")).collect()]
    assert said("google") == [None, "unsupported", "unsupported", "no_content"] and said("azure") == [None, None, "unsupported", "no_content"]
    assert said("textract") == ["unsupported", "unsupported", None, "no_content"] and said("textract", stored=F.lit(True)) == [None, None, None, "no_content"]


def test_jobs():
    replies = {None: [{"JobStatus": "IN_PROGRESS"}, {"JobStatus": "SUCCEEDED", "Blocks": [1], "NextToken": "a"}], "a": [{"Blocks": [2], "NextToken": "b"}], "b": [{"Blocks": [3]}]}
    waits = []
    assert ocr.textract_job(lambda: "j", lambda job, token: replies[token].pop(0), lambda: waits.append(1)) == [1, 2, 3] and len(waits) == 1
    for reply, kind in (({"JobStatus": "PARTIAL_SUCCESS"}, "bad_response"), ({"JobStatus": "IN_PROGRESS"}, "timeout"), ({"JobStatus": "SUCCEEDED", "NextToken": "x"}, "bad_response")):
        with pytest.raises(providers.ProviderError) as e:
            ocr.textract_job(lambda: "j", lambda job, token, r=reply: r, lambda: None, 3)
        assert e.value.kind == kind


def test_recognition_hooks_and_chains(spark):
    def bad(content):
        raise providers.ProviderError("unavailable")

    good = lambda content: [(w, 0.0, 0.0, 1.0, 1.0, 0, 0.5) for w in content.decode().split()]
    both = providers.chained_ocr([providers.Ocr("a", bad, bad), providers.Ocr("b", good), providers.Ocr("c", None, lambda content: [good(p) for p in content.split(b"|")])])
    df = spark.createDataFrame([(1, 1, bytearray(b"x y")), (2, 3, bytearray(b""))], "doc_id long, page int, image binary")
    seen = []
    stages = hooks.Stages(seen.append)
    rows = stages.watch(providers.recognise(df, both, 2), "ocr", F.col("error").isNotNull()).collect()
    stages.report()
    assert sorted((r.doc_id, r.page, r.text, r.provider, r.error) for r in rows if r.text) == [(1, 1, "x", "a+b+c", None), (1, 1, "y", "a+b+c", None)] and [(r.doc_id, r.page, r.error) for r in rows if not r.text] == [(2, 3, "no_content")]
    assert seen == [hooks.Event("ocr", 3, 1)]
    whole = df.withColumn("content", F.lit("p q|r").cast("binary"))
    assert sorted((r.doc_id, r.page, r.text) for r in providers.recognise_documents(whole, both, 2).collect()) == [(d, *w) for d in (1, 2) for w in ((1, "p"), (1, "q"), (2, "r"))]
    assert {r.error for r in providers.recognise_documents(whole, providers.Ocr("b", good), 1).collect()} == {"unsupported"}
    calls = []
    shut = providers.guarded(providers.Ocr("d", lambda c: calls.append(1) or bad(c), bad), 2, 30.0, lambda: 0.0)
    for _ in range(4):
        with pytest.raises(providers.ProviderError):
            shut.page(b"")
    assert len(calls) == 2
