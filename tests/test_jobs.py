"""Files, stores, streams, retries, SQL functions and the catalog on small fixtures."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import register
from foliant.operators import catalog, grounded, integrity, state
from foliant.sources import files, tables, versions
from foliant.streaming import jobs

DAY = datetime.datetime(2024, 5, 1)


@pytest.fixture()
def corpus(tmp_path):
    folder = tmp_path / "raw"
    (folder / "sub").mkdir(parents=True)
    (folder / "bir.TXT").write_bytes("birinchi\r\n\r\n\r\n\r\nikkinchi".encode())
    (folder / "sub" / "ikki.md").write_bytes(b"bad \xff byte")
    (folder / "uch.pdf").write_bytes(b"%PDF")
    (folder / "turt.exe").write_bytes(b"MZ")
    (folder / "katta.txt").write_bytes(b"x" * 500)
    return str(folder)


def test_corpus_accepts_and_rejects(spark, corpus):
    rows = files.read_text_corpus(spark, corpus, max_bytes=200)
    accepted = {r.name: r.text for r in files.accepted_files(rows).collect()}
    assert accepted == {"bir.TXT": "birinchi\n\n\n\nikkinchi", "ikki.md": "bad � byte"}
    rejected = {r.name: r.reject_reason for r in files.rejected_files(rows).collect()}
    assert rejected == {"uch.pdf": "not_text", "turt.exe": "extension", "katta.txt": "too_large"}


def with_meta(batch):
    values = {"module_code": "m-1", "module_name": "M", "topic_code": "t-1", "topic_name": "T", "type": "literature"}
    out = batch.where("reject_reason IS NULL").select(
        F.col("name").alias("material_id"), F.col("name").alias("original_filename"), "text")
    for name, value in values.items():
        out = out.withColumn(name, F.lit(value))
    return out


def test_ingest_is_incremental_and_repeatable(spark, corpus, tmp_path):
    sink, checkpoint = str(tmp_path / "md"), str(tmp_path / "cp")

    def run():
        stream = jobs.file_stream(spark, corpus, max_files=1)
        jobs.ingest(stream, sink, checkpoint, with_meta).awaitTermination()
        return {r.material_id: r.markdown for r in versions.read_newest(spark, sink).collect()}

    first = run()
    assert set(first) == {"bir.TXT", "ikki.md", "katta.txt"} and "## PART 2" in first["bir.TXT"]
    with open(f"{corpus}/besh.txt", "w") as handle:
        handle.write("yangi")
    second = run()
    assert set(second) == {*first, "besh.txt"}
    # A repeated batch is the commit it was.
    job = jobs.job_of(spark, checkpoint)
    again = versions.read_newest(spark, sink).where("material_id = 'besh.txt'").drop("commit", "version")
    last = versions.manifests(spark, sink).selectExpr("max(batch)").first()[0]
    assert not versions.commit(again.withColumn("markdown", F.lit("other")), sink, job, last)
    assert {r.material_id: r.markdown for r in versions.read_newest(spark, sink).collect()} == second


def test_export_writes_the_exact_text(spark, tmp_path):
    df = spark.createDataFrame([("m/a.md", "bir\n\nikki\n")], "md_path string, markdown string")
    files.export_markdown(df, str(tmp_path / "out"))
    written = list((tmp_path / "out").rglob("part-*"))
    assert len(written) == 1 and written[0].read_text() == "bir\n\nikki\n"


def test_rejected_files_are_not_opened(spark, corpus, monkeypatch):
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "300")
    try:
        rows = files.read_text_corpus(spark, corpus, max_bytes=200)
        assert {r.name for r in files.rejected_files(rows).collect()} == {"uch.pdf", "turt.exe", "katta.txt"}
        assert {r.name for r in files.accepted_files(rows).collect()} == {"bir.TXT", "ikki.md"}
        # With the limit above what the reader takes, it is the reader that refuses.
        with pytest.raises(Exception, match="katta"):
            files.read_text_corpus(spark, corpus, max_bytes=1000).collect()
    finally:
        spark.conf.unset(limit)
    plan = rows._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,200)" in plan
    assert rows.select("path", "size", "file_hash").count() == 5


def test_coverage_of_a_document_in_parts(spark):
    mark = "[MANBA: a.pdf | page 1 | t | literature]"
    whole = "x" * 950 + mark + "y" * 30 + mark + "z" * 2500 + mark + "é" * 10
    cuts = [0, 500, 950, 950 + len(mark) + 10, 2000, 3000, len(whole)]
    parts = [("d", i, whole[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    parts += [("one", 7, whole), ("none", 0, "n" * 1500), ("none", 1, "m" * 700), ("empty", 0, ""), ("null", 0, None)]
    df = spark.createDataFrame(parts, "doc string, part int, markdown string")
    got = {r.doc: tuple(r)[1:] for r in grounded.document_coverage(df, "doc", "part").collect()}
    single = grounded.coverage(spark.createDataFrame([("d", whole)], "doc string, markdown string"), ["doc"]).first()
    assert got["d"] == got["one"] == tuple(single)[1:] == (3, 2500, 4, 3)
    assert got["none"] == (0, 2200, 3, 0) and got["empty"] == (0, 0, 0, 0)


def test_coverage_is_linear(spark):
    """Four times the text may not take sixteen times as long; three megabytes take seconds."""
    mark = "[MANBA: a.pdf | page 1 | t | literature]"
    text = (mark + "x" * 600) * 5000
    df = spark.createDataFrame([(1, text)], "doc int, markdown string")
    started = time.time()
    row = grounded.coverage(df, ["doc"]).first()
    assert (row.markers, row.largest_gap, row.windows) == (5000, 600, -(-len(text) // 1000)) and time.time() - started < 20


def test_merge_leaves_other_folders_alone(spark, tmp_path):
    schema = "file_hash string, dpi int, page_no int, text string, confidence double, error string"
    path = str(tmp_path / "results")
    rows = [(f"{h}{i}", 300, 1, "old", 50.0, None) for h in ("aa", "bb", "cc") for i in range(4)]
    tables.write_page_results(spark.createDataFrame(rows, schema), path)

    def names(h):
        return sorted(p.name for p in (tmp_path / "results" / f"hash2={h}").glob("part-*"))

    before = {h: names(h) for h in ("aa", "bb", "cc")}
    fresh = [("bb0", 300, 1, "new", 90.0, None), ("bb0", 300, 2, "page", 90.0, None), ("cc0", 300, 1, "", 0.0, "timeout"),
             ("dd0", 300, 1, "first", 70.0, None)]
    assert tables.merge_page_results(spark, spark.createDataFrame(fresh, schema), path) == ["bb", "dd"]
    assert names("aa") == before["aa"] and names("cc") == before["cc"] and names("bb") != before["bb"]
    found = {(r.file_hash, r.page_no): r.text for r in tables.read_page_results(spark, path).collect()}
    assert len(found) == 14 and (found["bb0", 1], found["bb0", 2], found["bb1", 1], found["cc0", 1], found["dd0", 1]) == (
        "new", "page", "old", "old", "first")
    assert tables.merge_page_results(spark, spark.createDataFrame(fresh[2:3], schema), path) == []
    one = tables.read_page_results(spark, path, ["bb1"])
    assert one.count() == 1


def test_a_repeated_run_replaces_its_own_trail(spark, tmp_path):
    schema = "log_id string, material_id string, level string, created_at timestamp_ntz"
    path = str(tmp_path / "audit")

    def rows(*ids):
        return spark.createDataFrame([(i, "m", "info", DAY) for i in ids], schema)

    tables.append_audit(rows("a", "b"), path, "r1")
    tables.append_audit(rows("c"), path, "r2")
    tables.append_audit(rows("a", "b"), path, "r1")
    assert sorted(r.log_id for r in tables.read_audit(spark, path).collect()) == ["a", "b", "c"]


def test_catalog_tables_are_read_with_their_schemas(spark, tmp_path):
    from foliant import schemas

    for name in ("modules", "topics", "materials", "audit_logs"):
        spark.createDataFrame([], schemas.TABLES[name]).write.parquet(str(tmp_path / name))
    topic = ("t", "m", "c", "n", "d", 2, DAY, DAY)
    spark.createDataFrame([topic], schemas.TOPICS).write.mode("append").parquet(str(tmp_path / "topics"))
    found = tables.read_catalog(spark, str(tmp_path))
    assert {name: df.columns for name, df in found.items()} == {name: schemas.column_names(name) for name in found}
    assert tuple(found["topics"].first()) == topic
    # A folder of another module's rows has the same columns.
    assert found["audit_logs"].count() == 0


def test_topics_of_one_place_are_in_order_of_creation(spark):
    rows = [("a", 1, 1, DAY + datetime.timedelta(days=1)), ("b", 1, 1, DAY), ("c", 0, 5, DAY)]
    df = spark.createDataFrame(rows, "topic_id string, module_order int, topic_order int, created_at timestamp_ntz")
    assert [r.topic_id for r in df.orderBy(*catalog.topic_order()).collect()] == ["c", "b", "a"]


def test_slide_rows_have_the_schema(spark):
    from foliant import schemas
    from foliant.operators import sections

    rows = [("d", 1, 1, -1, "paragraph", "title"), ("d", 1, 2, 0, "cell", "a"), ("d", 1, 3, 0, "cell", "b"),
            ("d", 1, 4, 1, "cell", "c"), ("d", 1, 5, None, "note", "n")]
    (slide,) = sections.assemble_slides(spark.createDataFrame(rows, schemas.SLIDE_ELEMENTS)).collect()
    assert slide.text == "title\na | b\nc\n\n[Presenter Notes: n]"


def test_audit_appends_by_day(spark, tmp_path):
    schema = "log_id string, material_id string, level string, created_at timestamp_ntz"
    path = str(tmp_path / "audit")
    for day in (1, 2):
        rows = [(f"{day}-{i}", "m", "info", datetime.datetime(2024, 1, day, i)) for i in range(3)]
        tables.append_audit(spark.createDataFrame(rows, schema), path, f"run-{day}")
    assert tables.read_audit(spark, path).where("day = DATE'2024-01-02'").count() == 3
    assert tables.read_audit(spark, path).count() == 6


def test_fixed_schemas_parse(spark):
    from foliant import schemas

    for name, ddl in schemas.TABLES.items():
        assert spark.createDataFrame([], ddl).columns == schemas.column_names(name)


def test_retry_waits_double_to_the_cap(spark):
    detail = ["400: 429, message='Too Many Requests'"] * 4 + ["503"]
    rows = [(i, 1, DAY + datetime.timedelta(minutes=i), d) for i, d in enumerate(detail)]
    rows += [(10, 2, DAY, "file a10526f3-4290-4c7f-9f89-503f1409b613 missing"), (11, 3, DAY, "rate-limit")]
    df = spark.createDataFrame(rows, "event_id long, material_id long, failed_at timestamp_ntz, detail string")
    plan = {r.event_id: (r.action, r.wait_seconds) for r in state.retry_plan(df, attempts=5, cap=50.0).collect()}
    assert plan == {0: ("retry", 20.0), 1: ("retry", 40.0), 2: ("retry", 50.0), 3: ("retry", 50.0),
                    4: ("give_up", None), 10: ("give_up", None), 11: ("retry", 20.0)}


def test_duplicates_of_a_hot_content(spark):
    rows = [(i, 1, "same" if i % 3 == 0 else f"h{i}", DAY + datetime.timedelta(seconds=-i)) for i in range(900)]
    rows += [(1000, 2, "same", DAY), (1001, 1, None, DAY), (1002, 1, None, DAY)]
    df = spark.createDataFrame(rows, "material_id long, topic_id int, file_hash string, created_at timestamp_ntz")
    got = integrity.duplicates(df)
    assert got.count() == 299 and {r.duplicate_of for r in got.collect()} == {897}
    assert integrity.accepted(df).count() == 900 - 299 + 3


def test_paging(spark):
    df = spark.range(45).select(F.col("id").alias("material_id"), F.lit(DAY).cast("timestamp_ntz").alias("created_at"))
    page = catalog.paginate(df, catalog.newest_first("material_id"), 3)
    assert [r.material_id for r in page.collect()] == [40, 41, 42, 43, 44]
    assert tuple(catalog.page_info(df).first()) == (45, 1, 20, 3)
    assert tuple(catalog.page_info(df.limit(0), 1, 100).first()) == (0, 1, 100, 0)
    with pytest.raises(ValueError):
        catalog.page_info(df, 1, 500)
    after = catalog.keyset_page(df, "material_id", (DAY, 19))
    assert [r.material_id for r in after.collect()] == list(range(20, 40))


def test_master_is_not_created_for_nothing(spark):
    modules = spark.createDataFrame([("a", 1, "kb-1", False)], "code string, order_index int, kb_id string, is_active boolean")
    kbs = spark.createDataFrame([("kb-1", "A")], "kb_id string, name string")
    agents = spark.createDataFrame([("x", "X")], "agent_id string, name string")
    knowledge = state.master_knowledge(modules, kbs)
    assert state.master_action(knowledge, agents, "master").first().action == "none"
    assert state.master_action(knowledge, agents, "x").first().action == "update"
    active = state.master_knowledge(modules.withColumn("is_active", F.lit(True)), kbs)
    assert state.master_action(active, agents, "master").first().action == "create"


def test_sql_functions(spark):
    register.register(spark)
    row = spark.sql("""SELECT to_latin('Ўзбек ЕР') a, detect_script('salom dunyo bu') b, is_garbled('123 45') c,
        repair_typography('a \n b') d, nfc('é') e, fix_mixed_script_words('Тoшкeнт') f,
        normalise_apostrophes('ko`p') g, size(split_for_grounding(repeat('abc ', 400))) h,
        clean_text('e\u0301 \n b') i, clean_text(NULL) j""").first()
    assert tuple(row) == ("O‘zbek YER", "uz-latn", True, "a b", "é", "Тошкент", "ko‘p", 3, "é b", "")


def test_file_streams_drop_duplicates_like_the_batch(spark, tmp_path):
    rows = [(i, i % 3, f"h{i % 7}", DAY + datetime.timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "material_id long, topic_id int, file_hash string, created_at timestamp")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = str(tmp_path / "out")
    jobs.to_parquet(jobs.drop_duplicates(stream), sink, str(tmp_path / "cp")).awaitTermination()
    kept = spark.read.parquet(sink)
    assert kept.count() == 21 == kept.select("topic_id", "file_hash").distinct().count()


def test_status_feed_is_not_cut(spark):
    materials = spark.range(1000).selectExpr("id AS material_id", "'new' AS status")
    assert catalog.status_feed(materials, spark.range(150).selectExpr("id AS material_id")).count() == 150


def test_materials_without_a_hash_are_no_duplicates(spark):
    rows = [(1, "t", None), (2, "t", None), (3, "t", "h"), (4, "t", "h")]
    df = spark.createDataFrame(rows, "material_id int, topic_id string, file_hash string")
    assert {r.material_id for r in jobs.drop_duplicates(df).collect()} >= {1, 2}
    assert jobs.drop_duplicates(df).count() == 3
