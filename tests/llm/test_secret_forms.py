"""The field on kinds of secrets and of harmless tokens that its training doesn't make."""

import random
import re

import pytest

from skein.llm import secret_spans
from skein.llm.common import table

#: %d3: three drawn digits, %h: hexadecimal digits, %U: capitals, %b: letters and digits.
HARMLESS = (
    "seen 20%d2-0%d1-1%d1 1%d1:%d2:%d2.%d3+02:00 there", "id {%h8-%h4-%h4-%h4-%h12} was", "to NL%d2ABNA%d10 from us", "doi:10.%d4/s%d5-0%d2-%d5-x says", "fixed in commit %h10 today",
    "see PROJ-%d4 and OPS-%d3", "isbn 978-%d1-%d4-%d4-%d1 is", "order #ORD-2024-%d6 shipped", "from 2001:0db8:%h4:%h4::%h4:%h4 to", "device %h2:%h2:%h2:%h2:%h2:%h2 up", "release %d1.%d2.%d1-beta.%d1+build.%d4 out",
    "file IMG_2024%d4_%d6.jpg attached", "asin B0%U2%d1%U2%d1%U1%d1 sold", "https://tracker.example.org/issues/%d5?page=%d2#c%d4 has", "call +49 (0)30 %d4-%d4 now", "at %d2.%d6,-%d2.%d6 on",
    "paid EUR %d1,%d3.%d2 for", "parcel 1Z%d6%d10 came", "flight LH%d4 gate B%d2", "section 4.%d1.%d2(b) says", "call getUserById2 and parseHTML5Doc then", "open /usr/local/lib/python3.%d1/site-packages/x_%d1.py ok", "anchor #sec-%d1-%d2-intro here",
)
SECRETS = (
    "db is postgres://app:%b14@db.host/main ok", "Authorization: Basic %b30= sent", '{"signature": "%b40"} in', "AccountKey=%b44==;Endpoint=x", "post https://hooks.example.com/services/T%U8/B%U8/%b24 now", "MIIE%b60 line",
    "Cookie: session=%b32; path", "SharedAccessSignature sig=%b36 used", "//registry.example.org/:_authToken=npm_%b30 set", "dsn https://%h32@sentry.example.org/%d4 here", "header eyJ%b20.eyJ%b30.%b40 end", "bot xoxp-%d11-%d12-%b24 on",
    "ssh-ed25519 AAAAC3Nza%b40 me", "my access code: %b12%d2 keep", "smtp login anna / %b12%d2! now", "echo %b13%d2 | sudo -S ls",
)
DRAWN = {"d": "0123456789", "h": "0123456789abcdef", "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "b": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
PLAIN = "some plain words stand before and after it"


@pytest.fixture(scope="module")
def field(spark):
    return secret_spans.train(table(spark, "/root/testdata/sf0.001", "documents"))


def _lines(form, draw, n):
    for _ in range(n):
        yield f"{PLAIN} " + re.sub(r"%([dhUb])(\d+)", lambda m: "".join(draw.choices(DRAWN[m[1]], k=int(m[2]))), form) + f" {PLAIN}"


def test_precision_and_recall_on_kinds_not_trained(field):
    draw, n = random.Random(5), 30
    marked = {form: sum(any(k == "crf" for k, *_ in secret_spans.all_spans(x, field)[1]) for x in _lines(form, draw, n)) for form in HARMLESS}
    found = {form: sum(bool(secret_spans.all_spans(x, field)[1]) for x in _lines(form, draw, n)) for form in SECRETS}
    assert sum(found.values()) >= 0.95 * n * len(SECRETS)
    assert sum(found.values()) >= 0.9 * (sum(found.values()) + sum(marked.values()))
    assert sum(marked.values()) <= 0.02 * n * len(HARMLESS)


def test_rows_that_repeat_long_texts_and_clashing_columns(spark, field):
    long = " ".join(["plain words and no more of them"] * 30000) + " pwd: Xk29dkPq81mzT55w end"
    rows = [(1, long, "a", 1), (1, long, "b", 2), (2, None, None, None), (None, "pwd: Xk29dkPq81mzT55w", "", 0)]
    found = secret_spans.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int").repartition(3), field).collect()
    at = long.index("Xk29")
    spans = sorted((r["doc_id"] or 0, r["spans"]) for r in found)
    assert spans[1:] == [(1, f"crf:{at}:{at + 16}"), (1, f"crf:{at}:{at + 16}"), (2, "")] and spans[0][1].endswith(":21")
