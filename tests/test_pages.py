"""Page operators on small fixtures: literal results, and what must hold for any pages."""

import random


from foliant.operators import grounded, ordering, pages, sections
from foliant.plans import paged_books, text_corpus


def test_assemble_pages_follows_row_order(spark):
    words = [  # row, block, par, line, conf, text
        (1, 1, 1, 1, "80", "Salom"), (2, 1, 1, 1, "60", " dunyo "), (3, 1, 1, 2, "-1", "ikki"),
        (4, 1, 2, 1, "x", "uch"), (5, 1, 2, 1, "70", " "), (6, 2, 2, 1, "70", "to‘rt"),
        (7, 1, 1, 1, "70", "besh"),
    ]
    df = spark.createDataFrame(
        [("d", row, 5, 1, block, par, line, conf, text) for row, block, par, line, conf, text in words]
        + [("d", 0, 4, 1, 1, 1, 1, "-1", "skip")],
        "doc_id string, row_no long, level int, page int, block int, par int, line int, conf string, text string")
    row = sections.assemble_pages(df).first()
    assert row.text == "Salom dunyo\nikki\n\nuch\n\nto‘rt\n\nbesh"
    assert row.confidence == 70.0
    assert sections.page_confidence(df).first().confidence == 70.0


def test_slides(spark):
    rows = [
        ("d", 1, 1, 1, "paragraph", " Sarlavha "), ("d", 1, 2, 2, "cell", "a"),
        ("d", 1, 3, 2, "cell", " "), ("d", 1, 4, 2, "cell", "b"), ("d", 1, 5, 5, "note", "x \n y"),
        ("d", 2, 1, 1, "paragraph", "  "), ("d", 3, 1, 1, "note", "yolg‘iz"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, slide int, ord int, row int, kind string, text string")
    got = {r.slide: (r.label, r.text) for r in sections.assemble_slides(df).collect()}
    assert got == {
        1: ("slide 1", "Sarlavha\na | b\n\n[Presenter Notes: x y]"),
        3: ("slide 3", "[Presenter Notes: yolg‘iz]"),
    }


def lanes(spark, books):
    data = [(doc, i + 1, text, image) for doc, book in books.items() for i, (text, image) in enumerate(book)]
    df = spark.createDataFrame(data, "doc_id string, page_no int, text string, has_image boolean")
    return {r.doc_id: r.lane for r in pages.route_lanes(df).collect()}


def test_lanes(spark):
    text, scan = ("matnli sahifa " * 20, False), ("", True)
    got = lanes(spark, {
        "cover": [scan] + [text] * 30, "scanned": [scan] * 4, "half": [scan, text] * 15,
        "blank": [("", False)] * 4, "one": [scan],
    })
    assert got == {"cover": "default", "scanned": "ocr", "half": "ocr", "blank": "default", "one": "ocr"}


def random_books(seed, books=25):
    rng = random.Random(seed)
    lines = ["KITOB NOMI 1", "Kitob nomi 22 €", "— 7 —", "12", "|~|", "", "matn satri bir", "1991",
             "Tошкeнт shahri", "ko'plab so`z", "boshqa gap"]
    return {
        f"d{b}": {
            n + 1: "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 7)))
            for n in range(rng.randint(1, 14))
        } for b in range(books)
    }


def test_clean_pages_random(spark, monkeypatch):
    monkeypatch.setattr(pages, "BUCKET", 4096)
    books = random_books(4)
    data = [(doc, n, text) for doc, book in books.items() for n, text in book.items() if text]
    df = spark.createDataFrame(data, "doc_id string, page_no int, text string")
    got = {(r.doc_id, r.page_no): r.text for r in pages.clean_pages(df).collect()}
    assert set(got) == {(doc, n) for doc, n, _ in data}
    for (doc, n), text in got.items():
        # Repairs reach every line; only two lines at either edge can go, all others stay.
        for good, bad in (("Тошкент shahri", "Тoшкeнт"), ("ko‘plab soʻz"[:7], "ko'plab"), ("", "|~|")):
            assert bad not in text and (good in text or bad not in books[doc][n] or len(books[doc][n]) < 400)
        body = [x for x in books[doc][n].split("\n") if any(c.isalnum() for c in x)]
        assert len(body) - len([x for x in text.split("\n") if x.strip()]) <= 4


HEADED = {
    1: "KITOB NOMI 1\nmatn satri bir\n1", 2: "KITOB NOMI 2\nboshqa gap\n2", 3: "Kitob nomi 3\nTошкeнт\n3",
    4: "kitob nomi 4 €\nko'plab\n4", 5: "bosh\nmatn KITOB NOMI 1 ichida\noxir 1991",
}


def test_clean_pages(spark):
    df = spark.createDataFrame([("d", n, t) for n, t in HEADED.items()], "doc_id string, page_no int, text string")
    assert {r.page_no: r.text for r in pages.clean_pages(df).collect()} == {
        1: "matn satri bir", 2: "boshqa gap", 3: "Тошкент", 4: "ko‘plab",
        5: "bosh\nmatn KITOB NOMI 1 ichida\noxir 1991"}


UZ, RU, EN = "ўзбек тилида ҳужжат матни " * 9, "русский текст выше " * 9, "latin matn " * 40
PROBES = {
    # All pages are cached: nothing is read to find the language.
    "cached": ([(UZ, True)], ("uzb+uzb_cyrl+rus", 0)),
    "cached_half": ([(UZ, True), ("", False)], ("uzb_cyrl", 0)),
    "russian": ([(RU, False)], ("rus", 1)),
    "latin": ([("", False)] * 3 + [(EN, False)] * 4, ("uzb", 6)),
    "late": ([("12", False)] * 8 + [(UZ, False)] * 3, ("uzb_cyrl", 9)),
    "too_late": ([("12", False)] * 9 + [(UZ, False)] * 3, ("uzb+uzb_cyrl+rus", 9)),
    "blank": ([("", False)] * 2, ("uzb+uzb_cyrl+rus", 2)),
}


def test_probe_script(spark):
    data = [(d, n, t, c) for d, (book, _) in PROBES.items() for n, (t, c) in enumerate(book, 1)]
    df = spark.createDataFrame(data, "doc_id string, page_no int, text string, cached boolean")
    got = {r.doc_id: (r.language, r.pages_probed) for r in pages.probe_script(df).collect()}
    assert got == {doc: want for doc, (_, want) in PROBES.items()}


def test_warnings_in_emission_order(spark):
    schema = "doc_id string, page_no int, text string"
    layer = spark.createDataFrame([("a", 1, "qisqa"), ("a", 2, "x" * 60), ("b", 1, " ")], schema)
    results = spark.createDataFrame(
        [("a", 3, "", 0.0, "timeout"), ("a", 4, "yaxshi matn", 41.0, None)],
        schema + ", confidence double, error string")
    got = pages.page_warnings(pages.page_facts(layer, results)).orderBy("doc_id", "kind_no", "page_no").collect()
    assert [r.message for r in got] == [
        "OCR: 1 ta sahifa o'qilmadi: 3",
        "OCR: 1 ta sahifa past ishonch bilan o'qildi (< 60%): 4",
        "1-sahifada juda kam matn bor (5 belgi) — skanerlangan rasm bo'lishi mumkin.",
        "PDF ichidan matn topilmadi — hujjat skanerlangan va OCR talab qiladi.",
    ]
    without = pages.page_warnings(pages.page_facts(layer, results, unavailable=True), unavailable="yo'q")
    assert sorted((r.doc_id, r.kind_no) for r in without.collect()) == [("a", 1), ("a", 3), ("b", 4)]


def test_warnings_of_a_long_book_in_blocks(spark, monkeypatch):
    """Lists are cut after thirty pages whatever the blocks are; every sparse page has a message."""
    layer = spark.range(1, 201).selectExpr("'d' doc_id", "cast(id AS int) page_no", "'qisqa' text")
    results = spark.range(2, 150, 2).selectExpr(
        "'d' doc_id", "cast(id AS int) page_no", "'' text", "0D confidence", "'timeout' error")
    rows = results.unionByName(spark.range(301, 350).selectExpr(
        "'d' doc_id", "cast(id AS int) page_no", "concat('matn ', id) text", "10D confidence", "CAST(NULL AS string) error"))
    want = pages.page_warnings(pages.page_facts(layer, rows)).collect()
    monkeypatch.setattr(ordering.bucket_of, "__defaults__", (7,))
    got = pages.page_warnings(pages.page_facts(layer, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    read = set(range(2, 150, 2))
    assert sorted(r.page_no for r in got if r.kind_no == 3) == [n for n in range(1, 201) if n not in read]
    (failed,) = [r.message for r in got if r.kind_no == 1]
    assert failed == "OCR: 74 ta sahifa o'qilmadi: " + ", ".join(str(2 * n) for n in range(1, 31)) + " … (+44)"
    (low,) = [r.message for r in got if r.kind_no == 2]
    assert low.startswith("OCR: 49 ta sahifa past ishonch bilan o'qildi (< 60%): 301, ") and low.endswith(" … (+19)")


def test_outcomes_of_a_run(spark):
    layer = [("good", 1, "matn qatlami so‘zlari " * 4), ("good", 2, ""), ("empty", 1, " "), ("huge", 1, "matn"), ("huge", 2, ""),
             ("huge", 3, ""), ("unknown", 1, "kimniki bu matn"), ("text", 1, "faqat matn qatlami so‘zlari bor")]
    results = [("good", 2, "tanilgan meʼmor", 80.04, None, "uzb", False), ("good", 3, "", 0.0, "timeout", "uzb", False),
               ("good", 4, "keshdan", 70.0, None, "rus", True), *[("huge", n, "x so‘z", 50.0, None, "uzb", False) for n in (1, 2, 3, 4)]]
    layer = spark.createDataFrame(layer, "doc_id string, page_no int, text string")
    results = spark.createDataFrame(
        results, "doc_id string, page_no int, text string, confidence double, error string, languages string, cached boolean")
    meta = spark.createDataFrame([(d, *META) for d in ("good", "empty", "huge", "text")], ["doc_id", *grounded.META])
    facts = paged_books.recognised(layer, results)
    warnings, parts = pages.page_warnings(facts), paged_books.ground(facts, meta)
    rows = {r.doc_id: r for r in paged_books.outcomes(facts, meta, parts, warnings, max_pages=3).collect()}
    assert rows.keys() == {"good", "empty", "huge", "unknown", "text"}
    good = rows["good"]
    assert (good.status, good.chunk_count, good.extraction_method, good.ocr_page_count) == ("md_ready", 3, "mixed", 2)
    assert (good.ocr_confidence, good.ocr_languages, good.error_message) == (75.0, "uzb", None)
    assert (rows["text"].extraction_method, rows["text"].ocr_page_count, rows["text"].ocr_confidence) == ("text", 0, None)
    assert rows["empty"].error_message == text_corpus.NO_CONTENT + " " + pages.WARN_NOTHING
    assert rows["huge"].error_message == paged_books.TOO_MANY_PAGES % (4, 3)
    assert rows["unknown"].error_message == paged_books.NO_METADATA and rows["unknown"].chunk_count is None
    stats = {r.doc_id: r for r in pages.recognition_stats(facts).collect()}
    assert tuple(stats["good"])[1:] == (3, 1, 0, 1, 2, 75.0, "uzb")


def test_forced_files_are_read_anew(spark):
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "file_hash string, page_no int")
    results = spark.createDataFrame([("a", 1, 300, None), ("b", 1, 300, None)], "file_hash string, page_no int, dpi int, error string")
    forced = spark.createDataFrame([("b",), ("b",)], "file_hash string")
    assert {tuple(r) for r in pages.pages_todo(wanted, results, 300).collect()} == {("a", 2)}
    assert {tuple(r) for r in pages.pages_todo(wanted, results, 300, forced).collect()} == {("a", 2), ("b", 1)}


def test_long_page_lists_are_cut_but_counted(spark):
    problems = spark.range(1, 41).selectExpr("'d' doc_id", "cast(id as int) page_no", "'failed' problem")
    row = pages.page_lists(problems).first()
    assert row.pages == 40 and row.listed.endswith("29, 30 … (+10)")


META = ("m-1", 'Modul "A"', "t 1", "Mavzu", "literature", "we|ird]name.pdf")


HEAD = """---
module_id: "m-1"
module_name: "Modul \\"A\\""
topic_id: "t 1"
topic_name: "Mavzu"
type: "literature"
source: "we|ird]name.pdf"
script: "%s"
chunks: %d
---
"""
SECTION = """

## %s

[MANBA: we ird name.pdf | %s | t 1 | literature]

%s
"""


def section(label, text):
    return SECTION % (label.upper(), label, text)


def test_parts_concatenate_to_the_whole_markdown(spark, monkeypatch):
    rng = random.Random(6)
    book = {n: " ".join(rng.choice(["ўзбек", "ҳаёт", "ер", "китоб"]) for _ in range(rng.randint(0, 300)))
            for n in range(1, 23)}
    layer = spark.createDataFrame([("d", n, t) for n, t in book.items()], "doc_id string, page_no int, text string")
    meta = spark.createDataFrame([("d", *META)], ["doc_id", *grounded.META])
    (whole,) = paged_books.ground(layer, meta).collect()
    monkeypatch.setattr(grounded, "SECTIONS_PER_PART", 4)
    parts = paged_books.ground(layer, meta).orderBy("part").collect()
    assert len(parts) > 4
    assert "".join(p.markdown for p in parts) == whole.markdown
    filled = [n for n, t in book.items() if t.strip()]
    assert [x for x in whole.markdown.split("\n") if x.startswith("## ")] == [f"## PAGE {n}" for n in filled]
    text = "".join(x for x in whole.markdown.split("\n")[11:] if not x.startswith(("## ", "[MANBA")))
    latin = {"ўзбек": "o‘zbek", "ҳаёт": "hayot", "ер": "yer", "китоб": "kitob"}
    assert text.replace(" ", "") == "".join(latin[w] for t in book.values() for w in t.split())
    totals = paged_books.document_totals(paged_books.ground(layer, meta)).first()
    assert totals.char_count == sum(len(p.markdown) for p in parts)


def test_recognised_pages_are_grounded_over_the_layer(spark, monkeypatch):
    monkeypatch.setattr(grounded, "SAMPLE_BUCKET", 2)
    layer = {n: "" if n % 2 else f"matn qatlami {n} so‘zlari" for n in range(1, 13)}
    ocr = {n: f"SARLAVHA {n}\n" + ("" if n == 5 else f"tanilgan {chr(97 + n) * 3} me'mor") for n in layer if n % 2}
    schema = "doc_id string, page_no int, text string"
    layer_df = spark.createDataFrame([("d", n, t) for n, t in layer.items()] + [("leer", 1, " ")], schema)
    ocr_df = spark.createDataFrame([("d", n, t) for n, t in ocr.items()], schema)
    meta = spark.createDataFrame([(d, *META) for d in ("d", "leer")], ["doc_id", *grounded.META])
    rows = paged_books.ground(layer_df, meta, ocr_df).collect()
    texts = {n: layer[n] or f"tanilgan {chr(97 + n) * 3} meʼmor" for n in layer if n != 5}
    assert [r.markdown for r in rows] == [
        HEAD % ("uz-latn", 11) + "".join(section(f"page {n}", t) for n, t in texts.items())]
    none = spark.createDataFrame([("leer", 4, 0, "sabab")], "doc_id string, kind_no int, page_no int, message string")
    failed = paged_books.failures(pages.page_facts(layer_df, ocr_df), none).collect()
    assert [(r.doc_id, r.error_message) for r in failed] == [("leer", text_corpus.NO_CONTENT + " sabab")]


def test_text_documents_whole(spark):
    texts = ["bir\n\n\n\n\nikki\n\n\nuchinchi qism", "  \n\n\n ", "a " * 330 + "\r\n\r\n\r\n" + "é", None]
    df = spark.createDataFrame([(i, t, *META) for i, t in enumerate(texts)], ["material_id", "text", *grounded.META])
    got = {r.material_id: r for r in text_corpus.ground(df).collect()}
    assert got[0].markdown == HEAD % ("uz-latn", 3) + section("part 1", "bir") + section("part 2", "ikki") + section(
        "part 3", "uchinchi qism")
    assert got[0].marker_count == 3
    mark = "[MANBA: we ird name.pdf | part 1 | t 1 | literature]"
    long = ("a " * 301).strip() + f"\n\n{mark}\n\n" + ("a " * 29).strip()
    assert got[2].markdown == HEAD % ("uz-latn", 2) + section("part 1", long) + section("part 2", "é")
    assert got[2].marker_count == 3
    assert got[1].status == "failed" and got[1].markdown is None
    assert got[3].status == "failed"


def test_words_are_not_shuffled(spark):
    """Pages laid out by page give words that are assembled where they are."""
    from foliant.sources.fixtures import Tables

    words = Tables(spark, "/root/testdata/sf0.001").words_by_page
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (words, sections.assemble_pages(words))]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_words_of_unknown_place(spark):
    """NULL numbers neither shift a word's fields nor open a paragraph."""
    rows = [("d", 1, 3, 5, 1, 1, 1, "9", "c"), ("d", 1, 1, 5, None, 1, 1, "9", "a"),
            ("d", 1, 2, 5, 1, None, 2, "9", "b"), ("d", 1, 4, 5, 1, 1, None, "9", "e")]
    words = spark.createDataFrame(
        rows, "doc_id string, page int, row_no long, level int, block int, par int, line int, conf string, text string")
    assert [r.text for r in sections.assemble_pages(words).collect()] == ["a\nb\nc e"]


def test_outcomes_are_stored(spark):
    """What is made of a run's outcomes reads rows, and grounds no book again."""
    layer = spark.createDataFrame([("d", 1, True, 1, "some text " * 9)], "doc_id string, page_no int, has_image boolean, item long, text string")
    results = spark.createDataFrame(
        [], "doc_id string, page_no int, text string, confidence double, error string, cached boolean, languages string")
    meta = spark.createDataFrame([("d", *"abcdef")], ["doc_id", *grounded.META])
    facts = paged_books.recognised(layer, results)
    done = paged_books.outcomes(facts, meta, paged_books.ground(facts, meta), pages.page_warnings(facts))
    assert "Aggregate" not in done._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.status) for r in done.collect()] == [("d", "md_ready")]


def test_totals_are_those_of_the_markdown_without_gathering_it(spark):
    """Three parts, pages that are cut and one whose text is of no width."""
    texts = [(n, "\u200b" if n == 7 else "so‘z  va\nmatn " * (n % 90 + 1)) for n in range(5, 2100, 3)]
    layer = spark.createDataFrame([(b, n, t) for b in "ab" for n, t in texts], "doc_id string, page_no int, text string")
    meta = spark.createDataFrame(
        [(b, "m", "n", "t | u", "T", "literature", f"{b}.pdf") for b in "ab"],
        "doc_id string, module_code string, module_name string, topic_code string, topic_name string, type string, original_filename string")
    totals = paged_books.totals(layer, meta)
    want = paged_books.document_totals(paged_books.ground(layer, meta))
    assert sorted(totals.select(want.columns).collect()) == sorted(want.collect())
    assert totals.select(want.columns).dtypes == want.dtypes and totals.first().parts == 3
    # The sample of the head is all that is gathered.
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
