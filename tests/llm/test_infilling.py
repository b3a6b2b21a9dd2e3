"""Fill-in-middle outputs against the same written out in Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from skein.llm import infilling as I


def _made(key, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((a % (len(u) + 1), b % (len(u) + 1)))
    prefix, middle, suffix = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return len(u), "plain", None, None, text
    if d % 100 < 20:
        return len(u), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(u), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_outputs_and_what_they_restore(spark):
    draw = random.Random(2)
    texts = [None, "", " ", "a", "<", "<P", "<P<S", "<S><P>", "x<M>y", "P>S>M>", "\r\n\t\0", "é😀e\u0301 Straße", "a-b_c9 ", "\ufeffx", "<<<", "word " * 30000]
    texts += ["".join(draw.choices("ab <>PSM\n😀é", k=draw.randint(1, 40))) for _ in range(300)]
    rows = [(n, t, "clash", 7) for n, t in enumerate(texts)] + [(None, "no key", None, None), (-5, "below zero", "", 1), (3, "a", "again", 2), (3, "other text", "again", 2), ((1 << 62), "large", "", 0)]
    found = I.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(4))
    back = found.withColumn("back", I.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in back), key=repr) == sorted(((k, t or "", *_made(k, t)) for k, t, _, _ in rows), key=repr)
    assert all(r["back"] == r["text"] for r in back)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}


def test_digests_and_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = I.digests(I.fill_in_middle(docs))
    assert not re.search("Exchange|Python|Arrow", made._jdf.queryExecution().executedPlan().toString())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in made.collect():
        n, form, prefix, middle, output = _made(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, prefix, middle, sha(output), sha(texts[r["doc_id"]]))


def test_no_rows(spark):
    assert I.digests(I.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
