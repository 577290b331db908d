"""The ingest loop on real files: batches, quarantine, killed and repeated batches, replacement, reset."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.storage import Versioned
from corvane.streaming.ingest import Library

LONG = "Alpha beta gamma delta. " * 40


def put(folder, files, at=1_700_000_000):
    for name, raw in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if raw == "docx":
            body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Written in a document</w:t></w:r></w:p></w:body></w:document>'
            with zipfile.ZipFile(path, "w") as z:
                z.writestr("word/document.xml", body)
        else:
            with open(path, "wb") as f:
                f.write(raw)
        os.utime(path, (at, at))


FIRST = {"k1/a.txt": LONG.encode(), "k1/b.md": "# Über\n\nText mit Wörtern".encode(), "k2/c.html": b"<html><p>Seen</p><script>unseen()</script></html>", "k2/bad.json": b"{no", "k2/scan.pdf": b"%PDF", "k2/empty.txt": b" \n", "k1/~$lock.txt": b"x", "k2/d.docx": "docx"}
SECOND = {"k1/e.txt": "你好世界和平".encode("gb18030"), "k2/t.csv": b"x,y\n1,2\n", "k2/broken.docx": b"not a zip"}


def shape(library):
    """What a reader sees, without paths of this machine and versions."""
    name = F.element_at(F.split("storage_path", "/"), -1)
    docs = sorted(tuple(r) for r in library.documents().select("knowledge_base_id", "name", "file_type", "n_chars", "n_chunks").collect())
    bad = sorted((r[0], r[1].split(":")[0]) for r in library.quarantine().select(name, "reason").collect())
    chunks = sorted((r["content"], r["seq"]) for r in library.chunks().collect())
    terms = sorted((r["term"], r["df"], r["total"]) for r in library.index.totals().collect())
    return docs, bad, chunks, terms


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "drop"), f"file://{tmp_path}/store", f"file://{tmp_path}/checkpoint"


def test_files_of_any_kind(spark, places):
    drop, root, checkpoint = places
    put(drop, FIRST)
    library = Library(Versioned(spark, root))
    counts = library.ingest(f"file://{drop}", checkpoint)
    put(drop, SECOND)
    assert library.ingest(f"file://{drop}", checkpoint) != counts
    docs, bad, chunks, terms = shape(library)
    assert [(d[0], d[1]) for d in docs] == [("k1", "a.txt"), ("k1", "b.md"), ("k1", "e.txt"), ("k2", "c.html"), ("k2", "d.docx"), ("k2", "t.csv")]
    assert bad == [("bad.json", "JSONDecodeError"), ("broken.docx", "BadZipFile"), ("empty.txt", "empty document"), ("scan.pdf", "no parser for pdf")]
    assert dict((d[1], d[4]) for d in docs)["a.txt"] == len([c for c in chunks if c[0].startswith(("Alpha", "lpha", "pha", "ha ", "a b"))]) or dict((d[1], d[4]) for d in docs)["a.txt"] > 1
    assert ("seen", 1, 1) in terms and not [t for t in terms if t[0] == "unseen"] and ("你好世界和平", 1, 1) in terms
    assert library.counts() == {"documents": 6, "chunks": len(chunks), "quarantined": 4}
    hits = library.index.search(spark.createDataFrame([(1, "wörtern")], "query_id long, text string"), 3).collect()
    assert len(hits) == 1
    # nothing new: no new version
    version = library.store.version
    library.ingest(f"file://{drop}", checkpoint)
    assert library.store.version == version


@pytest.mark.parametrize("files_a_batch", [1, 3])
def test_any_split_into_batches_gives_the_same(spark, places, tmp_path, files_a_batch):
    drop, root, checkpoint = places
    some = {k: v for k, v in FIRST.items() if k[:2] == "k2" or k == "k1/b.md"}
    put(drop, some)
    whole = Library(Versioned(spark, root))
    whole.ingest(f"file://{drop}", checkpoint)
    split = Library(Versioned(spark, root + "2"))
    split.ingest(f"file://{drop}", checkpoint + "2", files_a_batch=files_a_batch)
    assert split.store.version > whole.store.version
    assert shape(split) == shape(whole)


def test_a_killed_and_repeated_batch_changes_nothing(spark, places):
    drop, root, checkpoint = places
    put(drop, FIRST)

    class Killed(Library):
        """Dies once before and once after its commit."""

        deaths = ["before", "after"]

        def publish(self, arrived, batch):
            commit = self.store.commit
            if self.deaths and self.deaths[0] == "before":
                self.deaths.pop(0)

                def die(*a, **b):
                    raise RuntimeError("killed")

                self.store.commit = die
            note = super().publish(arrived, batch)
            self.store.commit = commit
            if self.deaths:
                self.deaths.pop(0)
                raise RuntimeError("killed")
            return note

    for expected_version in (0, 1):
        library = Killed(Versioned(spark, root))
        with pytest.raises(Exception, match="killed"):
            library.ingest(f"file://{drop}", checkpoint)
        assert Versioned(spark, root).version == expected_version
    library = Killed(Versioned(spark, root))
    counts = library.ingest(f"file://{drop}", checkpoint)
    assert library.store.version == 1
    once = Library(Versioned(spark, root + "-once"))
    assert once.ingest(f"file://{drop}", checkpoint + "-once") == counts
    assert shape(library) == shape(once)


def test_files_that_come_again_replace(spark, places):
    drop, root, checkpoint = places
    put(drop, {"k1/a.txt": b"old words here", "k1/b.txt": b"steady words", "k2/c.json": b"{}"})
    library = Library(Versioned(spark, root))
    library.ingest(f"file://{drop}", checkpoint)
    put(drop, {"k1/a.txt": b"new words now", "k1/b.txt": b" ", "k2/c.json": b'{"mended": 1}'}, at=1_700_000_100)
    library.publish(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{drop}"), "again")
    docs, bad, chunks, terms = shape(library)
    assert [d[1] for d in docs] == ["a.txt", "c.json"] and bad == [("b.txt", "empty document")]
    assert {t[0] for t in terms} == {"new", "words", "now", "mended"} and len(chunks) == 2
    library.compact()
    assert library.store.table("gone") is None and shape(library) == (docs, bad, chunks, terms)
    library.reset("k1")
    docs, bad, _, terms = shape(library)
    assert [d[1] for d in docs] == ["c.json"] and not bad and {t[0] for t in terms} == {"mended"}


def test_one_path_twice_in_a_batch(spark, places):
    rows = [("x/k/a.txt", 5, b"later text"), ("x/k/a.txt", 1, b"earlier text"), ("x/k/z", 1, b"no extension")]
    frame = spark.createDataFrame(rows, "path string, t long, content binary").selectExpr("path", "timestamp_seconds(t) AS modificationTime", "length(content) AS length", "content")
    library = Library(Versioned(spark, places[1]))
    assert library.publish(frame, "b") == {"documents": 1, "chunks": 1, "quarantined": 1}
    assert [r["content"] for r in library.chunks().collect()] == ["later text"]
