"""The store of versions: repeated batches, clashing jobs, lost checkpoints, moves, compaction."""

import shutil

import pytest

from foliant.sources import versions
from foliant.streaming import jobs
from tests.test_jobs import corpus, with_meta  # noqa: F401

SCHEMA = "material_id string, part long, status string, module_dir string, markdown string"


def rows(spark, *values):
    return spark.createDataFrame([(m, p, s, d, t) for m, p, s, d, t in values], SCHEMA)


def newest(spark, path):
    found = versions.read_newest(spark, path).select("material_id", "part", "module_dir", "markdown").collect()
    return {(r.material_id, r.part): (r.module_dir, r.markdown) for r in found}


def test_the_same_batch_twice_is_one_commit(spark, tmp_path):
    store = str(tmp_path / "s")
    batch = rows(spark, ("a", 0, "md_ready", "m1", "one"), ("b", 0, "md_ready", "01", "two"))
    assert versions.commit(batch, store, "job", 0) and not versions.commit(batch, store, "job", 0)
    assert newest(spark, store) == {("a", 0): ("m1", "one"), ("b", 0): ("01", "two")}
    assert versions.read_all(spark, store).count() == 2


def test_two_jobs_with_the_same_batch_number(spark, tmp_path):
    store = str(tmp_path / "s")
    versions.commit(rows(spark, ("a", 0, "md_ready", "m1", "one")), store, "left", 0)
    versions.commit(rows(spark, ("b", 0, "md_ready", "m1", "two")), store, "right", 0)
    assert set(newest(spark, store)) == {("a", 0), ("b", 0)}


def test_a_moved_book_leaves_no_parts_behind(spark, tmp_path):
    store = str(tmp_path / "s")
    versions.commit(rows(spark, *[("a", p, "md_ready", "m1", f"old {p}") for p in range(3)]), store, "j", 0)
    versions.commit(rows(spark, *[("a", p, "md_ready", "m2", f"new {p}") for p in range(2)]), store, "j", 1)
    want = {("a", 0): ("m2", "new 0"), ("a", 1): ("m2", "new 1")}
    assert newest(spark, store) == want
    # A failed version does not replace a good one, a good one replaces a failed one.
    versions.commit(rows(spark, ("a", 0, "failed", "m2", None), ("b", 0, "failed", "m1", None)), store, "j", 2)
    assert newest(spark, store) == want | {("b", 0): ("m1", None)}
    versions.commit(rows(spark, ("b", 0, "md_ready", "m1", "good")), store, "j", 3)
    assert newest(spark, store) == want | {("b", 0): ("m1", "good")}


def test_data_without_a_manifest_is_not_seen(spark, tmp_path):
    store = str(tmp_path / "s")
    versions.commit(rows(spark, ("a", 0, "md_ready", "m1", "one")), store, "j", 0)
    versions.commit(rows(spark, ("a", 0, "md_ready", "m1", "lost")), store, "j", 1)
    lost = versions.manifests(spark, store).where("batch = 1").first().commit
    shutil.rmtree(f"{store}/commits/commit={lost}")
    assert newest(spark, store) == {("a", 0): ("m1", "one")}
    assert versions.commit(rows(spark, ("a", 0, "md_ready", "m1", "again")), store, "j", 1)
    assert newest(spark, store) == {("a", 0): ("m1", "again")}


def test_compaction_keeps_what_came_meanwhile(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    for batch in range(4):
        versions.commit(rows(spark, ("a", 0, "md_ready", "m1", f"a{batch}"), (f"b{batch}", 0, "md_ready", "m1", "b")),
                        store, "j", batch)
    before = newest(spark, store)
    plain = versions.read_newest

    def meanwhile(session, path):
        monkeypatch.setattr(versions, "read_newest", plain)
        versions.commit(rows(spark, ("a", 0, "md_ready", "m2", "later")), store, "other", 0)
        return plain(session, path)

    monkeypatch.setattr(versions, "read_newest", meanwhile)
    assert versions.compact(spark, store)
    assert newest(spark, store) == before | {("a", 0): ("m2", "later")}
    assert versions.commits_in_force(spark, store).count() == 2
    assert versions.unread_folders(spark, store).count() == 4
    # What was compacted is still known as stored.
    assert not versions.commit(rows(spark, ("a", 0, "md_ready", "m1", "x")), store, "j", 2)
    assert versions.compact(spark, store) and not versions.compact(spark, store)
    assert newest(spark, store) == before | {("a", 0): ("m2", "later")}


def test_a_new_store_has_nothing(spark, tmp_path):
    assert versions.manifests(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        versions.read_newest(spark, str(tmp_path / "none"))
    versions.commit(rows(spark), str(tmp_path / "e"), "j", 0)
    versions.commit(rows(spark, ("a", 0, "md_ready", "m", "x")), str(tmp_path / "e"), "j", 1)
    assert newest(spark, str(tmp_path / "e")) == {("a", 0): ("m", "x")}


def test_a_lost_checkpoint_overwrites_nothing(spark, corpus, tmp_path):  # noqa: F811
    sink = str(tmp_path / "md")

    def run(folder, checkpoint):
        stream = jobs.file_stream(spark, folder, max_files=1)
        jobs.ingest(stream, sink, str(checkpoint), with_meta).awaitTermination()
        return {r.material_id: r.markdown for r in versions.read_newest(spark, sink).collect()}

    first = run(corpus, tmp_path / "cp")
    assert len(first) == 3 and run(corpus, tmp_path / "cp") == first
    # Its batch 0 is another commit now, of the same documents.
    assert run(corpus, tmp_path / "cp2") == first
    other = tmp_path / "raw2"
    other.mkdir()
    (other / "olti.txt").write_text("oltinchi")
    assert set(run(str(other), tmp_path / "cp3")) == {*first, "olti.txt"}
