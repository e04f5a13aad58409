"""Fill-in-middle against a walk over units one by one."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import fim

TEXTS = [None, "", "a", "  ", "one two\nthree", "naïve 東京 café x1y2", "with <P> in it", "end <", "<S", "<<P", "\r\n\0 z", "word " * 3000, "x" * 50_000, "<M" * 20, "A-b_C"]


def plain(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", text, None, None
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(units), form, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS * 12)] + [(None, "no id", "kept"), (5, TEXTS[5], "kept"), (5, TEXTS[5], "kept")]
    return spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)


def test_equals_a_walk_over_the_units(docs):
    got = fim.fill_in_middle(docs, "doc_id", "text").collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[2:]) == plain(r.doc_id, r.text)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_every_text_comes_back(docs):
    out = fim.fill_in_middle(docs, "text")
    assert out.where(F.coalesce("text", F.lit("")) != fim.restored(F.col("output"), F.col("form"))).count() == 0


def test_clashing_names_other_units_and_empty_tables(docs):
    wide = docs.select("doc_id", "text", F.lit(1).alias("fim_text"), F.lit(2).alias("FIM_KEY"), F.lit(3).alias("n"))
    got = fim.fill_in_middle(wide, "fim_text", "FIM_KEY", "n")
    assert got.columns == ["fim_text", "FIM_KEY", "n", "form", "output", "prefix_chars", "middle_chars"] and got.where("n = 3 AND form = 'psm'").count() < got.count()
    lines = fim.fill_in_middle(docs, "text", unit=r"[^\n]*\n|[^\n]+").where("form = 'psm'").collect()
    assert all(len(r.text[: r.prefix_chars]) in (0, len(r.text)) or r.text[r.prefix_chars - 1] == "\n" for r in lines)
    assert fim.fill_in_middle(docs.limit(0), "doc_id").collect() == []


def test_query_returns_every_document(spark, sf):
    rows = fim.op11_fill_in_middle(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, form, output, low, middle = plain(r.doc_id, texts[r.doc_id])
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, low, middle, digest(output), digest(texts[r.doc_id] or ""))
