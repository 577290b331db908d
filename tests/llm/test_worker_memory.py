"""What the pipeline's stages hold in an executor besides its heap: Python workers and state stores."""

import tracemalloc

import numpy as np
import pyarrow as pa

from corvane.llm import exact_dedup, toxicity


def test_features_leave_a_worker_few_at_a_time():
    texts = [f"an id1ot number {k} and f.o.o.l" if k % 7 else None for k in range(5 * toxicity.FEW + 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([k % 2 for k in range(len(texts))], pa.int32()), pa.array(texts)], ["label", "text"])
    restorer = toxicity.Restorer(np.ones(toxicity.GRAMS, np.int64))
    got = list(toxicity.featured(iter([batch]), restorer))
    assert max(b.num_rows for b in got) == toxicity.FEW
    assert [f for b in got for f in b.column("f").to_pylist()] == [sorted({f for w in restorer.words(t or "") for f in toxicity.features(w)}) for t in texts]
    assert [x for b in got for x in b.column("label").to_pylist()] == batch.column("label").to_pylist()


def test_counting_grams_takes_little_beside_the_table():
    text = ("some words of a text à y 123 " * 12_000)[: toxicity.COUNTED]
    total = np.zeros(toxicity.WIDEST, np.int64)
    tracemalloc.start()
    toxicity.count_grams(text, total)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < total.nbytes + 8 * len(text)  # no second table, and a few numbers a character
    assert total.sum() > len(text)


def test_committed_state_is_closed(spark):
    docs = spark.createDataFrame([(k, f"text {k % 5}") for k in range(20)], "doc_id long, text string")
    stores = getattr(spark._jvm.org.apache.spark.sql.execution.streaming.state, "StateStore$").__getattr__("MODULE$")
    field = next(f for f in stores.getClass().getDeclaredFields() if f.getName().endswith("loadedProviders"))
    field.setAccessible(True)
    before = field.get(stores).size()
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == [15, 16, 17, 18, 19]
    assert field.get(stores).size() <= before
