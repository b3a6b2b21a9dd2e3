import heapq

from skein.llm import sharding


def test_large_sizes_are_placed_exactly(spark, monkeypatch):
    for name, value in (("EXACT_BYTES", 16), ("LARGE_GROUPS", 1), ("STEPS", 4)):
        monkeypatch.setattr(sharding, name, value, raising=False)
    sizes = [600 + 37 * k % 400 for k in range(50)]
    docs = spark.createDataFrame([(k, f"{k:03d}".ljust(n - 1, "x")) for k, n in enumerate(sizes)], "doc_id long, text string")
    heap = [(0, s) for s in range(7)]
    for n in sorted(sizes, reverse=True):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + n, shard))
    found = {}
    for r in sharding.shard_documents(docs, 7).collect():
        found[r["shard"]] = found.get(r["shard"], 0) + r["size"]
    assert found == {s: load for load, s in heap}
