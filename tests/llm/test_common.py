"""Python workers give back what a task took."""

import pyarrow as pa

from memlake.llm import alike, common, lz_dedup, packing, toxicity


def held():
    import re

    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_lean_gives_memory_back():
    def f(batches):
        kept = [bytes(1000) for _ in range(100_000)]
        pins = kept[::500]
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(kept)])], ["n"])
            del kept
        PINS.append(pins)

    before = held()
    (out,) = list(common.lean(f)(iter([1])))
    assert out["n"].to_pylist() == [100_000] and held() - before < 40
    assert common.lean(lambda a, b: a + b)(1, 2) == 3


PINS = []


def test_every_function_of_the_stages_is_lean(spark, monkeypatch):
    """Each MapInArrow and applyInArrow of the Python stages ends with released()."""
    seen = []
    kinds = [(type(spark.range(1)), "mapInArrow"), (type(spark.range(1).groupBy("id")), "applyInArrow"), (type(spark.range(1).groupBy("id").cogroup(spark.range(1).groupBy("id"))), "applyInArrow")]
    for kind, name in kinds:
        monkeypatch.setattr(kind, name, lambda self, f, schema, old=getattr(kind, name): seen.append(f) or old(self, f, schema))
    docs = spark.createDataFrame([(i, f"text {i} of a few more words here") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    toxicity.fit(docs, labels)
    alike.keep_one(docs)
    lz_dedup.lz_dedup(docs).count()
    packing.pack(docs)
    assert len(seen) >= 13 and all(f.__code__.co_filename == common.__file__ for f in seen)
