import hashlib
import json

from lexmill.operators import ocr
from lexmill.sources.files import bridge_of, eval_set, folders_of, read_documents, with_defaults, with_source, write_documents, first_of_each, read_ocr_pages, scan_folder


def test_scan_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    for name, body in {"a/One.PDF": b"1", "a/b/two.pdf": b"1", "a/b/three.v2.pdf": b"3", "a/note.txt": b"4", "a/.x.pdf": b"5", ".hidden/y.pdf": b"6"}.items():
        (tmp_path / name).write_bytes(body)
    files = scan_folder(spark, str(tmp_path))
    got = {r["name"]: r for r in files.collect()}
    assert set(got) == {"One", "two", "three.v2"}
    assert got["two"]["hash"] == hashlib.sha256(b"1").hexdigest() and got["two"]["folder"].endswith("/a/b")
    assert sorted(r["name"] for r in first_of_each(files).collect()) == ["One", "three.v2"]
    known = spark.createDataFrame([(hashlib.sha256(b"3").hexdigest(),)], "hash string")
    assert [r["name"] for r in first_of_each(files, known).collect()] == ["One"]


def test_ocr_pages(spark, tmp_path):
    pages = [{"page": 2, "markdown": " c\n"}, {"markdown": "", "text": " a "}, {"page": 2, "text": "d", "extra": 1}, {"page": 1}]
    (tmp_path / "h1.json").write_text(json.dumps({"meta": {}, "pages": pages}, indent=1))
    (tmp_path / "h2.json").write_text("{ not json")
    (tmp_path / "h3.json").write_text("{}")
    got = [tuple(r) for r in read_ocr_pages(spark, str(tmp_path)).orderBy("hash", "place").collect()]
    assert got == [("h1", 0, "a"), ("h1", 1, ""), ("h1", 2, "c"), ("h1", 3, "d")]


def test_folders_and_sources_of_a_directory(spark, tmp_path):
    for name in ("a.pdf", "x/b.PDF", "x/y/z/c.pdf", "other/d.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    root = f"file:{tmp_path}"
    files = spark.createDataFrame([(r.folder,) for r in scan_folder(spark, str(tmp_path)).select("folder").collect()], "folder string")
    got = {(r.path.removeprefix(root), r.name, r.parent_path and r.parent_path.removeprefix(root)) for r in folders_of(files, root).collect()}
    assert got == {("", tmp_path.name, None), ("/x", "x", ""), ("/x/y", "y", "/x"), ("/x/y/z", "z", "/x/y")}
    sources = spark.createDataFrame([(4, "lib", "zotero", "7")], "id long, name string, source_type string, path string")
    once = with_source(sources, root)
    assert [(r.id, r.name) for r in once.orderBy("id").collect()] == [(4, "lib"), (5, tmp_path.name)]
    assert with_source(once, root + "/").count() == 2


def test_documents_are_replaced_as_a_whole(spark, tmp_path):
    schema = "seed int, size int, strata map<string,int>, paper_ids array<long>"
    sample = spark.createDataFrame([(3, "old"), (1, "cjk"), (2, "old")], "id long, stratum string")
    write_documents(eval_set(sample, 42, 3), str(tmp_path / "eval"))
    write_documents(eval_set(sample.where("id < 3"), 43, 2), str(tmp_path / "eval"))
    (row,) = read_documents(spark, str(tmp_path / "eval"), schema).collect()
    assert (row.seed, row.size, row.strata, row.paper_ids) == (43, 2, {"cjk": 1, "old": 1}, [1, 2])


def test_older_tables_get_their_columns(spark):
    paper = spark.createDataFrame([(1, 7), (2, None)], "id long, folder_id long")
    got = with_defaults(paper, {"date": "", "folder_id": 0}).orderBy("id").collect()
    assert [(r.date, r.folder_id) for r in got] == [("", 7), ("", None)]
    assert [tuple(r) for r in bridge_of(paper).collect()] == [(1, 7)]


def test_ocr_results_with_their_meta(spark, tmp_path):
    good = {"total_pages": 2, "done_pages": 1, "failed_pages": 1, "failed_page_numbers": [2, 2], "pages": [{"page": 0, "markdown": "a"}, {"page": 1, "text": ""}], "meta": {"schema_version": 1, "biblio_state": "applied"}}
    (tmp_path / "h1.json").write_text(json.dumps(good))
    (tmp_path / "h2.json").write_text(json.dumps({"total_pages": None}))
    (tmp_path / "h3.json").write_text("{broken")
    rows = ocr.read_results(spark, str(tmp_path))
    got = {r.hash: (r.valid, r.retry, r.state) for r in rows.select("hash", ocr.is_valid().alias("valid"), ocr.retry_pages().alias("retry"), "meta.biblio_state").toDF("hash", "valid", "retry", "state").collect()}
    assert got == {"h1": (False, [1], "applied"), "h2": (False, None, None)}
