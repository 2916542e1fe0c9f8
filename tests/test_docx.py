"""Word files by the data source: paragraphs, tables, broken files, splits, and both readers alike."""

from __future__ import annotations

import io
import json
import zipfile

from docspark.sources import docx, files


def made(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.NS}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


P = lambda *t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}" + "".join(f"<w:r><w:t>{x}</w:t></w:r>" for x in t) + "</w:p>"


def test_files(spark, tmp_path, monkeypatch):
    inner = f"<w:tbl><w:tr><w:tc>{P('deep')}</w:tc></w:tr></w:tbl>"
    table = f"<w:tbl><w:tr><w:tc>{P('a')}{P('b')}</w:tc><w:tc>{P('c')}{inner}</w:tc></w:tr><w:tr><w:tc>{P()}</w:tc></w:tr></w:tbl>"
    body = P("Title", style="Heading1") + P("one ", "two &amp; three") + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t></w:r></w:p>" + table + P() + table + P("end")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "good.docx").write_bytes(made(body))
    (tmp_path / "no zip.docx").write_bytes(b"not a zip")
    (tmp_path / "no xml.docx").write_bytes(made("<w:p>"))
    (tmp_path / "UPPER.DOCX").write_bytes(docx.package(["line 1", "", "tab\tand \x00 mark"]))
    (tmp_path / "other.txt").write_text("x")
    got = docx.load(spark, f"file://{tmp_path}").collect()
    good = [tuple(r)[1:8] for r in sorted(got, key=lambda r: r.ord) if r.path.endswith("good.docx")]
    assert good == [
        (0, "paragraph", None, None, None, "Heading1", "Title"), (1, "paragraph", None, None, None, None, "one two & three"), (2, "paragraph", None, None, None, None, "x\ty\nz"),
        (3, "cell", 0, 0, 0, None, "a\nb"), (4, "cell", 0, 0, 1, None, "c\ndeep"), (5, "cell", 0, 1, 0, None, ""), (6, "paragraph", None, None, None, None, ""),
        (7, "cell", 1, 0, 0, None, "a\nb"), (8, "cell", 1, 0, 1, None, "c\ndeep"), (9, "cell", 1, 1, 0, None, ""), (10, "paragraph", None, None, None, None, "end"),
    ]
    errors = {r.path.rsplit("/")[-1]: r.error.split(":")[0] for r in got if r.error}
    assert errors == {"no zip.docx": "BadZipFile", "no xml.docx": "ParseError"} and len([r for r in got if "no " in r.path]) == 2
    texts = {r.path.rsplit("/")[-1]: r.text for r in docx.texts(docx.load(spark, str(tmp_path))).collect()}
    assert texts["good.docx"] == "Title\none two & three\nx\ty\nz\n\nend" and texts["UPPER.DOCX"] == "line 1\n\ntab\tand   mark" and texts["no zip.docx"] == ""
    name = lambda r: (r.path.rsplit("/")[-1].replace("%20", " "), *tuple(r)[1:])
    both = sorted(map(name, docx.from_binary(spark, str(tmp_path)).collect()), key=str)
    assert both == sorted((name(r) for r in got if not r.path.endswith("DOCX")), key=str)  # the glob knows small letters only
    monkeypatch.setattr(docx, "SPLIT", 1)
    assert len(docx._Reader(str(tmp_path)).partitions()) == 4 and docx.load(spark, str(tmp_path)).count() == len(got)


def test_empty_folder_and_round_trip(spark, tmp_path):
    assert docx.load(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([(1, "a\n\nb <c> & d"), (2, ""), (3, None)], "doc_id long, text string")
    assert docx.write(df, f"file://{tmp_path}/out") == 3
    got = {r.path.rsplit("/")[-1]: r.text for r in docx.texts(docx.load(spark, f"file://{tmp_path}/out")).collect()}
    assert got == {"1.docx": "a\n\nb <c> & d", "2.docx": ""}  # no paragraph, no row


def test_bundles_are_the_same_at_every_run(spark, tmp_path):
    rows = [(1, "b", "y", 2), (1, "b", "x", None), (1, "a", "z", 1), (2, "a", 'q"\n', 1), (2, "a", 'q"\n', 1), (None, "a", "n", 1), (3, None, "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, part string, item_id string, page int")
    got = files.bundled(df)
    want = {(1, "b"): [{"item_id": "x", "page": None}, {"item_id": "y", "page": 2}], (1, "a"): [{"item_id": "z", "page": 1}], (2, "a"): [{"item_id": 'q"\n', "page": 1}] * 2}
    assert {(r.doc_id, r.part): json.loads(r.body) for r in got.collect()} == want and all(r.n_items == len(want[r.doc_id, r.part]) for r in got.collect())
    again = files.bundled(df.repartition(5))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    out = f"file://{tmp_path}/bundle"
    files.write_bundle(got, out)
    files.write_bundle(got.where("part = 'b'"), out)  # the other part stays
    lines = {(json.loads(r.value)["doc_id"], r.part): json.loads(r.value)["items"] for r in spark.read.text(out).collect()}
    assert lines == want
