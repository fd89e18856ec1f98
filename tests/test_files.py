"""Files in, files out, and streams."""

import json

from pyspark.sql import functions as F

from siftline.functions import vocab
from siftline.operators import hypotheses as hy
from siftline.session import cut_lineage
from siftline.sources import feeds, files, library_json, sinks, versions
from siftline.streaming import acquire, ingest


def put(folder, name, content):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_encoding_cascade(spark, tmp_path):
    put(tmp_path / "in", "a.txt", "﻿текст".encode("utf-8"))
    put(tmp_path / "in", "b.txt", "текст".encode("utf-8"))
    put(tmp_path / "in", "c.txt", "текст".encode("cp1251"))
    put(tmp_path / "in", "d.txt", b"\x98abc")
    got = {r["name"]: (r["text"], r["encoding"]) for r in files.decode(files.scan_files(spark, str(tmp_path / "in"))).collect()}
    # Plain UTF-8 already decodes as the first encoding; 0x98 is undefined in cp1251.
    assert got == {"a.txt": ("текст", "utf-8-sig"), "b.txt": ("текст", "utf-8-sig"), "c.txt": ("текст", "cp1251"), "d.txt": ("\x98abc", "latin-1")}


def test_delimited_file_to_cells(spark, tmp_path):
    put(tmp_path / "in", "s.csv", "experiment;temperature\r\nE-1;720\r\nE-2;760\r\n")
    cells = files.delimited_cells(files.decode(files.scan_files(spark, str(tmp_path / "in"))))
    assert cells.filter("row = 2 AND col = 2").first()["value"] == "760"
    assert files.read_delimited(spark, str(tmp_path / "in"), ";").columns == ["experiment", "temperature"]


def test_manifest(spark, tmp_path):
    put(tmp_path / "in", "a.txt", "x")
    old = files.scan_files(spark, str(tmp_path / "in")).select("path", "modified", "length")
    old.write.parquet(str(tmp_path / "manifest"))
    manifest = spark.read.parquet(str(tmp_path / "manifest"))
    put(tmp_path / "in", "b.zip", "y")
    now = files.scan_files(spark, str(tmp_path / "in"))
    assert [r["name"] for r in files.changed_files(now, manifest).collect()] == ["b.zip"]
    assert files.removed_files(now, manifest).count() == 0
    good, bad = files.supported(now)
    assert (good.count(), bad.count()) == (1, 1)


LIBRARY = {
    "title": "Base", "note": "N",
    "retrieval_playbook": {"goal": "g", "selection_rules": ["r1", " ", "r2"]},
    "domain_taxonomy": {"assets": ["pump"]},
    "sources": [{"source_id": "s1", "title": "T1", "summary": "sum", "year": 2020, "tags": ["a", "b"],
                 "key_passages": [{"heading": "H", "text": "X", "use_when": ["u", "v"]}, {}]}, {"title": "no content"}],
    "asset_profiles": [{"asset_type": "valve", "weak_zones": ["seat"]}],
    "failure_modes": [{"failure_mode_id": "f", "name": "leak", "common_triggers": ["age"]}],
    "process_signals": [{"name": "flow", "why_important": "it tells"}],
    "retrieval_examples": [{"query": "q" * 130, "rejected_passages": [{"passage_id": "p", "why_rejected": "w"}]}],
}


def test_library_files(spark, tmp_path):
    put(tmp_path / "lib", "base.json", "﻿" + json.dumps(LIBRARY))
    put(tmp_path / "lib", "bad.json", "{not json")
    found = library_json.read_files(spark, str(tmp_path / "lib"))
    parsed, errors = library_json.parse(found)
    rows = library_json.sources(parsed)
    got = {r["source_id"]: r for r in rows.collect()}
    assert set(got) == {"lib:base:playbook", "lib:base:taxonomy", "lib:base:s1", "lib:base:valve", "lib:base:f", "lib:base:flow", "lib:base:retrieval-example"}
    assert got["lib:base:playbook"]["content"] == "Corpus: Base\n\nNote: N\n\nGoal: g\n\nSelection rules:\n- r1\n- r2"
    assert got["lib:base:s1"]["content"] == "Summary: sum\n\nTags: a, b\n\nKey passages:\nHeading: H\n\nText: X\n\nUse when: u; v"
    assert got["lib:base:s1"]["year"] == 2020 and got["lib:base:s1"]["reference"] == "lib/base.json"
    assert got["lib:base:retrieval-example"]["title"] == "Retrieval example: " + "q" * 120 + "..."
    counts = {(r["metric"], r["name"]): r["count"] for r in library_json.status(found, rows, errors).collect()}
    assert counts[("files", None)] == 2 and counts[("errors", None)] == 1 and counts[("sources", None)] == 7


def test_feed_order():
    assert feeds.feed_order() == ["openalex", "crossref", "semantic_scholar"]
    assert feeds.feed_order(["crossref", "nope"], {"materials_project"}) == ["crossref", "materials_project"]
    assert feeds.feed_order(["nope"]) == ["openalex"]


def _ranked(spark):
    data = [(i, "p", f"st {i}", "g", None, None, "accepted", None, 50.0 + i, 60.0, 70.0, 10.0, ["a", "b"]) for i in range(3)]
    df = spark.createDataFrame(data, "hypothesis_id long, project_id string, statement string, goal_link string, mechanism string, validation string, status string, "
                               "expert_notes string, novelty double, value double, feasibility double, risk double, tags array<string>")
    df = df.withColumn("evidence", F.array(F.struct(F.lit("E").alias("title")))).withColumn("rationale", F.lit(None).cast("string"))
    return hy.rank(df, ["project_id"])


def test_exports(spark, tmp_path):
    ranked = _ranked(spark)
    sinks.write_csv(ranked.unionByName(ranked.withColumn("project_id", F.lit("q"))), str(tmp_path / "csv"), project_id="p")
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿rank,composite,status,statement") and text.splitlines()[1].startswith("1,")
    assert len(text.splitlines()) == 4
    sinks.write_csv(ranked.unionByName(ranked.withColumn("project_id", F.lit("q"))), str(tmp_path / "all"))
    assert {p.name for p in (tmp_path / "all").iterdir() if p.is_dir()} == {"project_id=p", "project_id=q"}
    sinks.write_json(ranked, str(tmp_path / "json"))
    lines = [json.loads(x) for f in sorted((tmp_path / "json").rglob("*.txt")) for x in f.read_text().splitlines()]
    assert [x["statement"] for x in lines] == ["st 2", "st 1", "st 0"] and lines[0]["sources"] == ["E"]
    projects = spark.createDataFrame([("p", "T", "K", "m", "decrease", None)], "project_id string, title string, kpi_target string, kpi_metric string, kpi_direction string, domain string")
    sinks.write_markdown(ranked, projects, str(tmp_path / "md"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "md").rglob("*.txt")))
    assert text.index("Всего гипотез: 3") < text.index("## 1. st 2") < text.index("## 3. st 0")
    assert "**Метрика: m (снизить)**  " in text


def test_lineage_is_cut_in_the_named_folder(spark):
    rows = cut_lineage(spark.range(5))
    assert rows.count() == 5 and rows.inputFiles()[0].startswith("file://" + spark.conf.get("spark.checkpoint.dir"))


def test_append_and_replace(spark, tmp_path):
    runs = spark.createDataFrame([(1, None), (2, "boom")], "run_id long, error string")
    sinks.append_runs(runs, str(tmp_path / "runs"))
    sinks.append_runs(runs, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 4
    first = spark.createDataFrame([("a", 1), ("b", 1)], "doc string, n int")
    again = spark.createDataFrame([("a", 2)], "doc string, n int")
    for rows in (first, again, again):
        sinks.replace_partitions(rows, str(tmp_path / "t"), "doc")
    assert sorted((r["doc"], r["n"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 2), ("b", 1)]


def test_drop_folder_stream_equals_batch(spark, tmp_path):
    inbox, out, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    put(inbox, "one.txt", "# Title\nA first line of text.\n")
    put(inbox, "empty.txt", " \n")
    put(inbox, "x.zip", "zz")
    ingest.start(spark, str(inbox), out, point).awaitTermination(120)
    put(inbox, "two.txt", "Some other text here.\n")
    ingest.start(spark, str(inbox), out, point).awaitTermination(120)
    rows, log = ingest.parse_files(files.scan_files(spark, str(inbox)))
    names = ["document_id", "chunk_index", "section_title", "text"]
    schema = rows.schema.simpleString()[7:-1].replace(":", " ")
    assert sorted(map(tuple, versions.read(spark, out + "/chunks", schema).select(names).collect())) == sorted(map(tuple, rows.select(names).collect()))
    assert statuses(spark, out) == {"one.txt": "parsed", "empty.txt": "parsed", "x.zip": "unsupported", "two.txt": "parsed"}
    # A replay from the start leaves the same tables.
    ingest.start(spark, str(inbox), out, str(tmp_path / "cp2")).awaitTermination(120)
    assert versions.read(spark, out + "/chunks", schema).count() == rows.count()
    assert log.count() == 4


def statuses(spark, out):
    log = versions.read(spark, out + "/log", "document_id string, status string, warnings array<string>, error string")
    return {r["document_id"].rsplit("/", 1)[1]: r["status"] for r in log.collect()}


def test_folder_sync_parses_what_it_logs(spark, tmp_path):
    """Delimited files get a table, types without a parser are unsupported, changed files
    replace their chunks, blank and removed ones leave none."""
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    put(inbox, "a.csv", "name;value\n" + "".join(f"n{k};{k}\n" for k in range(6000)))
    put(inbox, "b.txt", "Some words of the file.\n")
    put(inbox, "c.pdf", b"%PDF-1.4")
    put(inbox, "d.csv", "\n\n")
    assert ingest.sync(spark, str(inbox), out) == 4
    assert statuses(spark, out) == {"a.csv": "parsed", "b.txt": "parsed", "c.pdf": "unsupported", "d.csv": "parsed"}

    def texts(name):
        rows = versions.read(spark, out + "/chunks", "document_id string, kind string, text string").collect()
        return sorted((r["kind"], r["text"]) for r in rows if r["document_id"].endswith(name))

    assert [k for k, _ in texts("a.csv")] == ["table_summary", "text"]
    assert "has 6000 rows and columns: name, value" in texts("a.csv")[0][1] and '"n0"' in texts("a.csv")[0][1]
    assert texts("b.txt") == [("text", "Some words of the file.")] and not texts("c.pdf") and not texts("d.csv")
    assert ingest.sync(spark, str(inbox), out) == 0
    put(inbox, "b.txt", "Other and longer words of the same file.\n")
    assert ingest.sync(spark, str(inbox), out) == 1
    assert texts("b.txt") == [("text", "Other and longer words of the same file.")] and len(texts("a.csv")) == 2
    put(inbox, "b.txt", " \n")
    (inbox / "a.csv").unlink()
    assert ingest.sync(spark, str(inbox), out) == 2
    assert not texts("b.txt") and not texts("a.csv")
    assert statuses(spark, out) == {"b.txt": "parsed", "c.pdf": "unsupported", "d.csv": "parsed"}


def test_versions_merge_on_read(spark, tmp_path):
    """A write adds its own rows alone, a repeated one leaves one copy, an incomplete one does not count, and a compacted
    table reads the same."""
    path, schema = str(tmp_path / "t"), "document_id string, n long, extra string"

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "document_id string, n long")

    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "document_id string")

    def state():
        return sorted((r["document_id"], r["n"]) for r in versions.read(spark, path, schema).collect())

    assert state() == [] and versions.compact(spark, path, schema) is None
    versions.replace(rows(("a", 1), ("a", 2), ("b", 3)), ids("a", "b"), path, "one")
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    versions.replace(rows(("a", 4)), ids("a", "c"), path, "two")
    assert state() == [("a", 4), ("b", 3)]
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    versions.replace(rows(("a", 1), ("a", 2), ("b", 3)), ids("a", "b"), path, "one")  # repeated: as old as it was
    assert state() == [("a", 4), ("b", 3)] and len(versions.versions(spark, path)) == 2
    versions.replace(None, ids("b", "never"), path, "three")
    assert state() == [("a", 4)]
    versions.replace(rows(("a", 9)), ids("a"), path, "four")
    last = versions.versions(spark, path)[-1]
    (tmp_path / "t" / "documents" / last.folder / "_SUCCESS").unlink()
    assert state() == [("a", 4)]
    versions.replace(rows(("a", 5), ("d", 6)), ids("a", "d"), path, "four")
    assert state() == [("a", 5), ("d", 6)]
    versions.compact(spark, path, schema)
    assert state() == [("a", 5), ("d", 6)]
    assert versions.expire(spark, path) > 0 and len(versions.versions(spark, path)) == 1 and state() == [("a", 5), ("d", 6)]
    versions.replace(spark.createDataFrame([("d", "new column")], "document_id string, extra string"), ids("d"), path, "five")
    assert sorted(map(repr, versions.read(spark, path, schema).collect())) == ["Row(document_id='a', n=5, extra=None)", "Row(document_id='d', n=None, extra='new column')"]


def test_drop_folder_compaction(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    put(inbox, "a.txt", "Some words of a file.\n")
    put(inbox, "b.txt", "Some words of another file.\n")
    ingest.sync(spark, str(inbox), out)
    put(inbox, "b.txt", "Now it has other words, and more.\n")
    assert ingest.sync(spark, str(inbox), out) == 1
    schema = "document_id string, chunk_index long, text string"
    before = sorted(map(repr, versions.read(spark, out + "/chunks", schema).collect()))
    ingest.compact(spark, out)
    assert sorted(map(repr, versions.read(spark, out + "/chunks", schema).collect())) == before and len(before) == 2
    assert ingest.sync(spark, str(inbox), out) == 0
    (inbox / "a.txt").unlink()
    assert ingest.sync(spark, str(inbox), out) == 1 and versions.read(spark, out + "/chunks", schema).count() == 1


def test_stream_acquisition_deduplicates_across_batches(spark, tmp_path):
    schema = "project_id long, pos long, title string, year int, reference string, content string"
    inbox, out, point = str(tmp_path / "in"), str(tmp_path / "cat"), str(tmp_path / "cp")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(inbox)

    def step():
        acquire.start(spark, spark.readStream.schema(schema).json(inbox), out, point).awaitTermination(120)

    arrive([(1, 0, "A", 2000, "r1", "c"), (1, 1, "B", 2000, "R1 ", "c"), (1, 2, "C", None, None, "")])
    step()
    arrive([(1, 0, "a", 1999, None, "c"), (1, 1, "D", 2000, None, "c"), (2, 0, "A", 2000, "r1", "c")])
    step()
    got = acquire.read_catalogue(spark, out)
    assert sorted((r["project_id"], r["title"]) for r in got.collect()) == [(1, "A"), (1, "D"), (2, "A")]
    assert got.select("project_id", "source_id").distinct().count() == 3
    assert set(vocab.SUPPORTED_TYPES) >= {"txt"}
