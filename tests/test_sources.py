"""Text layers: a file per document, written by tasks and listed by few tasks, whatever the number of folders."""

import glob
import gzip
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from driver_checks import io
from tallymark.session import scratch_dir
from tallymark.sources.readers import read_text_layers
from tallymark.sources.writers import write_text_layers


def test_text_layers_round_trip(spark, tmp_path):
    """White space, other scripts, names that need escapes, a null text, and lines of one file; also below a file:/// root."""
    rows = [("a/1.txt", " x\n\n"), ("a/b c+%20#é.txt", "ünï\r\nцод"), ("2.txt", None), ("b/3.txt", "two"), ("b/3.txt", "one")]
    for root in (f"{tmp_path}/plain", f"file://{tmp_path}/uri/", f"file:{tmp_path}/short"):
        write_text_layers(spark.createDataFrame(rows, "path string, text string"), root)
        got = {r.path: r.text for r in read_text_layers(spark, root).collect()}
        assert got == {"a/1.txt": " x\n\n\n", "a/b c+%20#é.txt": "ünï\r\nцод\n", "2.txt": "\n", "b/3.txt": "one\ntwo\n"}


def test_files_are_read_as_bytes_and_packed_ones_unpacked(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone\r\n\xff")
    (tmp_path / "b.gz.txt").write_text("two")
    (tmp_path / "none.txt").write_text("")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "c d.txt.gz").write_bytes(gzip.compress(b"three\n"))
    layers = read_text_layers(spark, str(tmp_path))
    assert "binaryfile" in layers._jdf.queryExecution().executedPlan().toString().lower()
    got = {r.path: r.text for r in layers.select("path", F.col("text").cast("binary").alias("text")).collect()}
    assert got == {"a.txt": b"\xef\xbb\xbfone\r\n\xff", "b.gz.txt": b"two", "d/c d.txt.gz": b"three\n"}


def test_an_empty_table_writes_no_file(spark, tmp_path):
    write_text_layers(spark.createDataFrame([], "path string, text string"), str(tmp_path))
    assert read_text_layers(spark, str(tmp_path)).count() == 0


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """One folder per document, as golden sets may have them."""
    for i in range(120):
        os.makedirs(tmp_path / f"d{i}")
        (tmp_path / f"d{i}" / "page.txt").write_text(str(i))
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, context = spark.conf.get(key), spark.sparkContext
    context.setJobGroup("listing", "text layers")
    try:
        layers = read_text_layers(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds]
    assert 0 < max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * context.defaultParallelism
    assert spark.conf.get(key) == before and {r.text for r in layers.collect()} == {str(i) for i in range(120)}


def test_pages_lie_in_a_bounded_number_of_folders(spark, tmp_path):
    ids = [*range(400), 7]
    pages = pa.table({"page_id": pa.array(ids, pa.int64()), "html": [None if i == 3 else f"<p>{i}</p>\n" for i in ids]})
    pq.write_table(pages, tmp_path / "pages.parquet")
    before = set(glob.glob(f"{scratch_dir(spark)}/layers-*"))
    layers = {r.path: r.text for r in io.read_text_layers(spark, str(tmp_path)).collect()}
    assert layers == {f"pages/{i}.txt": "" if i == 3 else "<p>7</p>\n\n<p>7</p>\n" if i == 7 else f"<p>{i}</p>\n" for i in range(400)}
    root, = set(glob.glob(f"{scratch_dir(spark)}/layers-*")) - before
    assert len(glob.glob(f"{root}/*")) <= 256 and len(glob.glob(f"{root}/**/*.txt", recursive=True)) == 400


def test_eval_set_over_pages(spark, tmp_path):
    """OCR mode end to end: a third of the documents show another page's text, and the files are read by one scan for both layers."""
    ids = range(300)
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "html": [f"<p>{i}</p>" for i in ids]}), tmp_path / "pages.parquet")
    before = set(glob.glob(f"{scratch_dir(spark)}/layers-*"))
    sets = io.eval_set(spark, str(tmp_path))
    rows = {r.id: r for r in sets.collect()}
    for i in ids:
        shown = i // 2 if i % 5 and i % 3 == 0 else i
        assert (rows[f"doc-{i}"].text, rows[f"doc-{i}"].text_layer) == (f"<p>{shown}</p>", f"<p>{i}</p>")
    assert len(rows) == 300 and "ReusedExchange" in sets._jdf.queryExecution().executedPlan().toString()
    root, = set(glob.glob(f"{scratch_dir(spark)}/layers-*")) - before
    assert len(glob.glob(f"{root}/*")) <= 256
