"""PDF files: made here, read back, split, and written as files by name."""

import os
import zlib

import pytest

from tenderlake.functions.pdf import Name, Pdf, PdfError, Ref, Stream, assemble, parse, write
from tenderlake.sources import pdf as source

N = Name


def flate(data, **more):
    return Stream({N("Filter"): N("FlateDecode")} | more, zlib.compress(data))


def shown(text, font=b"/F1"):
    lines = text.split("\n")
    body = b"".join(b"0 -14 Td (" + line.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj " for line in lines)
    return b"BT " + font + b" 11 Tf 50 800 Td " + body + b"ET"


def make_pdf(texts, stream=flate):
    """A document with a page for each text, its page tree in two levels."""
    objects = [{N("Type"): N("Catalog"), N("Pages"): Ref(2, 0)}, None, {N("Type"): N("Font"), N("Subtype"): N("Type1"), N("BaseFont"): N("Helvetica"), N("Encoding"): N("WinAnsiEncoding")}]
    groups = []
    for at in range(0, len(texts), 3):
        objects.append(None)
        group, kids = len(objects), []
        for t in texts[at : at + 3]:
            objects.append(stream(shown(t)))
            objects.append({N("Type"): N("Page"), N("Parent"): Ref(group, 0), N("Contents"): Ref(len(objects), 0)})
            kids.append(Ref(len(objects), 0))
        objects[group - 1] = {N("Type"): N("Pages"), N("Parent"): Ref(2, 0), N("Kids"): kids, N("Count"): len(kids)}
        groups.append(Ref(group, 0))
    objects[1] = {N("Type"): N("Pages"), N("Kids"): groups, N("Count"): len(texts), N("Resources"): {N("Font"): {N("F1"): Ref(3, 0)}}, N("MediaBox"): [0, 0, 595, 842]}
    return assemble(objects)


def packed_pdf(text):
    """Objects in a stream of objects, a cross-reference stream with a predictor, and a font with a map of its own."""
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <00FF> <0100> endbfrange 1 beginbfchar <0000> <D83DDE00> endbfchar 1 beginbfrange <1000> <1001> [<0041> <00420043>] endbfrange endcmap"
    codes = "".join("0000" if c == "\U0001f600" else f"{ord(c) - 0xFF:04x}" for c in text) + "10001001"
    inner = {1: {N("Type"): N("Catalog"), N("Pages"): Ref(2, 0)}, 2: {N("Type"): N("Pages"), N("Kids"): [Ref(3, 0)], N("Count"): 1}, 3: {N("Type"): N("Page"), N("Parent"): Ref(2, 0), N("Contents"): [Ref(4, 0)], N("Resources"): {N("Font"): {N("G"): Ref(5, 0)}}}, 5: {N("Type"): N("Font"), N("Subtype"): N("Type0"), N("Encoding"): N("Identity-H"), N("ToUnicode"): Ref(6, 0)}}
    bodies = {k: write(v) for k, v in inner.items()}
    heads, body = [], b""
    for k, b in bodies.items():
        heads.append(f"{k} {len(body)}")
        body += b + b" "
    first = " ".join(heads).encode() + b" "
    parts = {4: flate(b"BT /G 9 Tf 1 0 0 1 9 9 Tm [<" + codes[:8].encode() + b"> -300 <" + codes[8:].encode() + b">] TJ ET"), 6: flate(cmap), 7: flate(first + body, **{"Type": N("ObjStm"), "N": len(inner), "First": len(first)})}
    parts[7].head = {N(k): v for k, v in parts[7].head.items()}
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for k, v in parts.items():
        places[k] = len(out)
        out += b"%d 0 obj\n" % k + write(v) + b"\nendobj\n"
    start = len(out)
    places[8] = start
    rows = [b"\0\0\0\0"] + [(b"\2" + (7).to_bytes(2, "big") + bytes([list(inner).index(i)])) if i in inner else b"\1" + places[i].to_bytes(2, "big") + b"\0" for i in range(1, 9)]
    up = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(row, before, strict=True)) for row, before in zip(rows, [b"\0" * 4, *rows], strict=False))
    xref = flate(up)
    xref.head = {N("Type"): N("XRef"), N("Size"): 9, N("W"): [1, 2, 1], N("Root"): Ref(1, 0), N("Filter"): N("FlateDecode"), N("DecodeParms"): {N("Predictor"): 12, N("Columns"): 4}}
    out += b"8 0 obj\n" + write(xref) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    return bytes(out)


TEXTS = [f"Page {i}: Marché n° {i} (lot {i * 7})\nMontant \\ 1 000 € à côté" for i in range(11)]


def test_pages_come_back():
    pdf = Pdf.of(make_pdf(TEXTS))
    assert pdf.n_pages() == 11 and [pdf.text(p) for p in pdf.pages()] == TEXTS
    assert [p.number for p in pdf.pages(4, 6)] == [4, 5] and list(pdf.pages(11)) == []
    plain = Pdf.of(make_pdf(TEXTS[:1], lambda data: Stream({}, data)))
    assert [plain.text(p) for p in plain.pages()] == TEXTS[:1]
    coded = Pdf.of(make_pdf(TEXTS[:1], lambda data: Stream({N("Filter"): [N("ASCIIHexDecode"), N("FlateDecode")]}, zlib.compress(data).hex().encode() + b">")))
    assert [coded.text(p) for p in coded.pages()] == TEXTS[:1]
    packed = Pdf.of(packed_pdf("ŁÓDŹ".replace("Ó", "ő").replace("D", "đ") + "\U0001f600"))
    assert [packed.text(p) for p in packed.pages()] == ["Łő đŹ\U0001f600ABC"]


def test_pages_can_be_taken_out():
    pdf = Pdf.of(make_pdf(TEXTS))
    part = Pdf.of(pdf.copy_pages([9, 0, 3]))
    assert [part.text(p) for p in part.pages()] == [TEXTS[9], TEXTS[0], TEXTS[3]]
    again = Pdf.of(Pdf.of(packed_pdf("ŁłŃń")).copy_pages([0]))
    assert again.text(next(again.pages())) == "Łł ŃńABC"
    with pytest.raises(PdfError):
        pdf.copy_pages([11])


def test_objects_survive_writing():
    for value in ({N("A b#"): [1, -2.5, True, None, b"\0(x", Ref(3, 1), {N("K"): N("")}]}, [], b"", 0.125):
        assert parse(write(value), 0)[0] == value
    assert parse(rb"(a\(b\)(c)\101\n\
d)", 0)[0] == b"a(b)(c)A\nd"


@pytest.mark.parametrize("cut", [0, 3, 200, -40, -900])
def test_a_broken_file_is_an_error_of_its_own(cut):
    data = make_pdf(TEXTS)[:cut] if cut else b""
    with pytest.raises((PdfError, ValueError)):
        pdf = Pdf.of(data)
        [pdf.text(p) for p in pdf.pages()]


def test_bytes_changed_at_random_end_in_a_page_or_an_error():
    import random

    dice, data = random.Random(8), make_pdf(TEXTS[:3])
    for _ in range(300):
        bad = bytearray(data)
        for _ in range(4):
            bad[dice.randrange(len(bad))] = dice.randrange(256)
        try:
            pdf = Pdf.of(bytes(bad))
            [pdf.text(p) for p in pdf.pages(0, 5)]
        except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError):
            pass  # the data source reports any of these


def test_a_folder_of_files_is_a_table_of_pages(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deeper").mkdir(parents=True)
    (folder / "a.pdf").write_bytes(make_pdf(TEXTS))
    (folder / "deeper/b.pdf").write_bytes(make_pdf(["one page"]))
    (folder / "broken.pdf").write_bytes(make_pdf(TEXTS)[:900])
    (folder / "empty.pdf").write_bytes(b"")
    (folder / "note.txt").write_text("no")
    want = [("a.pdf", i, 11, t) for i, t in enumerate(TEXTS)] + [("b.pdf", 0, 1, "one page")]
    for split in (16 << 20, 500):
        df = source.read_pages(spark, str(folder), split_bytes=split)
        rows = df.collect()
        assert sorted((os.path.basename(r.path), r.page_no, r.n_pages, r.text) for r in rows if r.error is None) == want
        assert sorted(os.path.basename(r.path) for r in rows if r.error) == ["broken.pdf", "empty.pdf"]
        assert all(r.page_no is None for r in rows if r.error)
    assert df.rdd.getNumPartitions() > 3  # one file's pages in several tasks
    assert [r.text for r in source.read_pages(spark, f"file://{folder}", page=3).where("error IS NULL").collect()] == [TEXTS[3]]
    assert source.read_pages(spark, str(folder / "deeper")).select("n_pages").first()[0] == 1


def test_files_that_spark_reads_become_pages(spark, tmp_path):
    from tenderlake.sources.files import list_files, read_pdf_pages

    (tmp_path / "a.pdf").write_bytes(make_pdf(TEXTS[:4]))
    (tmp_path / "b.pdf").write_bytes(b"no")
    rows = read_pdf_pages(list_files(spark, f"file://{tmp_path}")).collect()
    assert sorted((r.page_no, r.text) for r in rows if r.error is None) == list(enumerate(TEXTS[:4])) and [r.page_no for r in rows if r.error] == [None]


def test_documents_are_trimmed_split_and_written_as_files(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for name, n in (("a.pdf", 5), ("b.pdf", 3), ("short.pdf", 2)):
        (folder / name).write_bytes(make_pdf(TEXTS[:n]))
    (folder / "broken.pdf").write_bytes(b"%PDF-1.4 no")
    files = spark.read.format("binaryFile").load(f"file://{folder}")
    for _ in range(2):  # files of one name are replaced
        source.write_files(source.split_pdfs(files), str(out))
    listed = sorted(os.path.relpath(os.path.join(d, f), out) for d, _, names in os.walk(out) for f in names)
    assert listed == ["a.pdf", "a/page_1.pdf", "a/page_2.pdf", "a/page_3.pdf", "b.pdf", "b/page_1.pdf"]
    pages = source.read_pages(spark, str(out)).collect()
    assert sorted((os.path.relpath(r.path, out), r.page_no, r.text) for r in pages) == sorted([("a.pdf", i, TEXTS[i + 1]) for i in range(3)] + [(f"a/page_{i}.pdf", 0, TEXTS[i]) for i in (1, 2, 3)] + [("b.pdf", 0, TEXTS[1]), ("b/page_1.pdf", 0, TEXTS[1])])
    source.write_text_files(source.read_pages(spark, str(folder)).where("error IS NULL"), str(tmp_path / "texts"))
    assert (tmp_path / "texts/b.txt").read_text(encoding="utf-8") == "".join(TEXTS[:3]) and sorted(os.listdir(tmp_path / "texts")) == ["a.txt", "b.txt", "short.txt"]
    source.write_text_files(source.read_pages(spark, str(folder)), str(tmp_path / "fan"), fan=True)
    assert sum(len(names) for _, _, names in os.walk(tmp_path / "fan")) == 4 and "b.txt" not in os.listdir(tmp_path / "fan")


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    good = spark.createDataFrame([(f"f{i}", bytearray(b"x")) for i in range(20)], "name string, content binary")
    bad = good.union(spark.createDataFrame([("../outside", bytearray(b"x"))], good.schema))
    with pytest.raises(Exception, match="no name of a file"):
        source.write_files(bad, str(tmp_path / "out"))
    assert [f for _, _, names in os.walk(tmp_path / "out") for f in names] == [] and not (tmp_path / "outside").exists()
    source.write_files(good, str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 20
