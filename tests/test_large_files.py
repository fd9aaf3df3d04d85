"""Files are never opened whole where their size is not bounded."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sightline.schemas import RESOURCE_COLUMNS
from sightline.sources import files as src
from sightline.sources.delimited import read_findings_csv
from sightline.sources.json_files import read_findings


@pytest.fixture
def small_values(spark):
    """No file above 20,000 bytes may be read as one value."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "20000")
    yield
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def csv_text(n):
    rows = [",".join(f"{c.lower()}{i}" for c in RESOURCE_COLUMNS) for i in range(n)]
    return "\n".join([",".join(RESOURCE_COLUMNS), *rows, ""])


def test_csv_larger_than_a_value(spark, tmp_path, small_values):
    """Such a file was read whole for its fingerprint and its format."""
    text = csv_text(200)
    assert len(text) > 100_000
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.json").write_text(json.dumps([{c: "x" for c in RESOURCE_COLUMNS}]))
    (tmp_path / "c").write_text(json.dumps([{c: "y" for c in RESOURCE_COLUMNS}]))
    digest = hashlib.sha256(text.encode()).hexdigest()
    assert {r.source_file_hash for r in read_findings_csv(spark, str(tmp_path), glob="*.csv").rows.collect()} == {digest}
    scan = read_findings(spark, str(tmp_path))
    counts = {r.sheet_name: r["count"] for r in scan.rows.groupBy("sheet_name").count().collect()}
    assert counts == {"csv": 200, "json": 2}
    assert scan.rejected.count() == 0


def test_csv_lines_are_not_shuffled(spark, tmp_path):
    """Lines went through windows over files and blocks and were grouped to records: all text was shuffled four times."""
    text = "\n".join([",".join(RESOURCE_COLUMNS), *[",".join(f'"{c}\n{i}"' for c in RESOURCE_COLUMNS) for i in range(60)], ""])
    (tmp_path / "a.csv").write_text(text)
    rows = read_findings_csv(spark, str(tmp_path)).rows
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")  # blocks shorter than a record
    try:
        again = read_findings_csv(spark, str(tmp_path)).rows
        assert again.rdd.getNumPartitions() > 60
        for scan in (rows, again):
            assert {(r.row_no, r.raw_region) for r in scan.collect()} == {(i + 2, f"REGION\n{i}") for i in range(60)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fingerprints_are_those_of_the_bytes(spark, tmp_path):
    bom = b"\xef\xbb\xbf"
    texts = [b"", b"\n", b"\n\n\n", b"a", b"a\n", b"a\nb", b"a\r\nb\r\n", b"\r", bom, bom + b"\n", bom + b"a\nb", bom + b"a\nb\n", b"\xff\xfe\x00\n\xe9",
             b"x" * 3_000_000 + b"\ny", b"line\n" * 50_000, b"a" + bom + b"\n"]
    for i, text in enumerate(texts):
        (tmp_path / f"f {i}+%.csv").write_bytes(text)
    import gzip

    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(b"a\nb\n"))
    found = {r.source_file: r.source_file_hash for r in src.fingerprints(spark, str(tmp_path)).collect()}
    want = {r.path: r.h for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.sha2("content", 256).alias("h")).collect()}
    assert found == want and len(want) == len(texts)  # Spark lists no file without bytes


def test_small_files_share_a_task(spark, tmp_path):
    """Each file had a task, and an output file, of its own; the longest file stays whole."""
    from pathlib import Path

    from sightline.session import shared_root

    for i in range(60):
        (tmp_path / f"{i}.csv").write_text("a,b\n" * (400_000 if i == 7 else i + 1))
    folder = Path(shared_root(spark)) / "sightline"
    before = set(folder.glob("digests-*"))
    found = {r.source_file_hash for r in src.fingerprints(spark, str(tmp_path)).collect()}
    assert found == {hashlib.sha256(f.read_bytes()).hexdigest() for f in tmp_path.glob("*.csv")}
    (made,) = set(folder.glob("digests-*")) - before
    assert len(list(made.glob("part-*.parquet"))) < 60


def test_files_are_hashed_once(spark, monkeypatch):
    """All bytes passed through the tasks for their fingerprints twice."""
    from sightline.plans import catalog
    from tests.test_stages import SF

    made, hashed = [], src.fingerprints
    monkeypatch.setattr(src, "fingerprints", lambda *a: made.append(a) or hashed(*a))
    catalog.QUERIES["scan_fingerprints"](spark, SF)
    assert len(made) == 1


def test_layouts_read_the_joined_findings(spark):
    """Every layout joined all line items to their orders and parts again."""
    from sightline.plans import catalog
    from tests.test_stages import SF

    t = catalog.Tables(spark, SF)
    catalog._layouts(t)
    assert "base" in t._kept and "raw" not in t._kept


def test_findings_read_again_are_not_joined_again(spark):
    """Each reading of the findings shuffled all line items to their orders; they are now joined once and written."""
    from sightline.plans.catalog import Tables
    from tests.test_stages import SF

    t = Tables(spark, SF)
    assert t.stored().exceptAll(t.raw()).isEmpty() and t.raw().exceptAll(t.stored()).isEmpty()
    read = " ".join(t.working().inputFiles())
    assert "findings-base" in read and "orders.parquet" not in read and "lineitem.parquet" not in read
    joined = t.processed().filter("report_inclusion = 'EXCLUDED' AND NOT is_duplicate").count()
    assert joined == t.filtered().filter("report_inclusion = 'EXCLUDED'").count()


def test_duplicates_are_joined_once(spark):
    """Each reading of processed findings joined its wide rows to the keys of duplicates, by a shuffle once these are many."""
    from sightline.operators import process
    from sightline.plans.catalog import Tables
    from tests.test_stages import SF

    t = Tables(spark, SF)
    read = " ".join(t.processed().inputFiles())
    assert "findings-base-marked" in read and "duplicate-keys" not in read and "part.parquet" not in read
    names = ["row_seq", "report_inclusion", "exclusion_reason", "is_duplicate", "duplicate_of", "raw_check_id", "dedup_key"]
    again = process.mark_duplicates(t.filtered(), t.duplicate_keys()).select(names)
    found = t.processed().select(names)
    assert found.exceptAll(again).isEmpty() and again.exceptAll(found).isEmpty()


def test_duplicates_are_found_by_one_shuffle(spark):
    """The rows were shuffled by two texts, and twice: once to find the keys of duplicates, once to join the rows to them."""
    from sightline.plans.catalog import Tables
    from tests.test_stages import SF

    t = Tables(spark, SF)
    t.processed()
    assert "duplicate_keys" not in t._kept
    base = t.base().schema
    assert base["key"].dataType.typeName() == "binary" and not {"l_quantity", "l_returnflag", "o_orderpriority"} & set(base.names)
    assert t.base().filter("length(key) <> 16").isEmpty()


def test_first_rows_by_either_way(spark):
    """Keys of one row, many rows, rows without key; and unlike runs whose texts run together."""
    from sightline.operators import process

    rows = [("r", "a", 5, "INCLUDED"), ("r", "a", 3, "INCLUDED"), ("r", "a", 1, "EXCLUDED"), ("r", "b", 2, "INCLUDED"), ("r", "", 7, "INCLUDED"),
            ("r", "", 8, "INCLUDED"), ("ra", "", 9, "INCLUDED"), ("1", "2:x", 10, "INCLUDED"), ("12", ":x", 11, "INCLUDED"), (None, "a", 12, "INCLUDED"), (None, "a", 13, "INCLUDED")]
    keyed = process.with_key(spark.createDataFrame(rows, "run_id string, dedup_key string, row_seq long, report_inclusion string"))
    want = {seq: None for _, _, seq, _ in rows} | {3: 3, 5: 3}
    for located in (process.locate_first_rows(keyed), process.with_first_rows(keyed, process.duplicate_keys(keyed))):
        assert {r.row_seq: r.primary_seq for r in located.collect()} == want


def test_findings_of_groups_are_joined_without_a_shuffle(spark):
    """The places of members were guessed to be large: all findings of the pages were shuffled, for the rows and for their counts."""
    from sightline.operators import report
    from sightline.plans.catalog import Tables
    from tests.test_stages import SF

    t = Tables(spark, SF)
    detail = report.resource_detail(t.approved(), t.groups(), t.working())
    assert "Exchange hashpartitioning" not in detail._jdf.queryExecution().executedPlan().toString()
    assert detail.count() == t.groups().agg(F.sum("instance_count")).first()[0]


def test_buckets_of_pages_follow_the_findings(spark, monkeypatch):
    """Pages of any number of findings went to 32 buckets, each sorted by one task."""
    from sightline.operators import exports
    from sightline.plans import catalog
    from tests.test_stages import SF

    made = []
    keep = lambda df, label, keys, buckets: made.append(buckets) or df
    monkeypatch.setattr(exports, "materialise_bucketed", keep)
    catalog.QUERIES["enriched_groups"](spark, SF)
    assert made == [32, 32]
    monkeypatch.setattr(exports, "BUCKET_ROWS", 50)
    catalog.QUERIES["enriched_groups"](spark, SF)
    assert made[2] == made[3] > 32


def test_records_are_split_once(spark, tmp_path):
    """The filter on empty rows split every record a second time, by another Python worker of the same task."""
    (tmp_path / "a.csv").write_text(csv_text(3).replace("severity1", '"severity, 1"'))
    rows = read_findings_csv(spark, str(tmp_path)).rows
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.raw_severity for r in rows.collect()} == {"severity0", "severity, 1", "severity2"}
