"""Cases that once went wrong: hot null ids, names that clash, places that don't prove anything, containers, crowds."""

import io
import random
import struct
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import _run, langid, licenses, media, mixing, neardup, quality, tokencounts, toxicity, urls
from tests.llm.test_operators import expected_components


def test_repeated_and_null_ids_of_token_counts(spark, tmp_path):
    """Of each text one row stays, that of the smallest id, nulls last; it alone is recounted without repeated lines."""
    rows = [(None, "a b\na b\nc", "en", "s"), (None, "a b\na b\nc", "en", "t"), (4, "a b\na b\nc", "de", "s"), (4, "a b\na b\nc", "de", "s"), (9, "x", None, None), (None, "x", "en", "s"), (None, "only null", "fr", "u"), (None, "only null", "fr", "u"), (1, None, "en", "v"), (2, None, "en", "v"), (3, "", "en", "w"), (5, "", "en", "w")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [("de", "s", "a b\nc"), (None, None, "x"), ("fr", "u", "only null"), ("en", "v", None), ("en", "v", None), ("en", "w", "")]
    counts = {r.text: r.n_tokens for r in tokencounts.with_tokens(spark.createDataFrame([(t,) for *_, t in kept], "text string"), "text").collect()}
    want = Counter()
    for lang, source, text in kept:
        want[source, lang, "documents"] += 1
        want[source, lang, "tokens"] += counts[text]
    got = Counter()
    for r in tokencounts.op2_token_counts(spark, str(tmp_path)).collect():
        got[r.source, r.lang, "documents"], got[r.source, r.lang, "tokens"] = r.documents, r.tokens
    assert got == want


def test_one_of_two_writers_commits(spark, tmp_path, monkeypatch):
    ledger = tokencounts.Ledger(spark, f"{tmp_path}/ledger")
    rows = spark.createDataFrame([("a", "en", "t", "insert", 5, None)], "source string, lang string, tokenizer string, kind string, n_tokens long, old_tokens long")
    with pytest.raises(ValueError, match="no batch id"):
        ledger.commit("../x", rows)
    assert ledger.commit("1", rows)
    # A second writer that looked before the first one had renamed its batch.
    seen = iter([False, True])
    monkeypatch.setattr(ledger, "committed", lambda batch: next(seen))
    assert not ledger.commit("1", rows)
    monkeypatch.undo()
    assert [(r.documents, r.tokens) for r in ledger.totals().collect()] == [(1, 5)]


def test_key_phrases_elsewhere_prove_nothing(spark):
    texts = ["Licensed under the Apache License, Version 1.1, made with version 2.0 of the tool", "Licensed under the Apache License, Version 2.0", "licence granted under the apache license version 2 0"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n_words int, text string")
    got = {r.text: r for r in licenses.scan(rows, licenses.BASE, licenses.NOTICES, "n_words", "text").collect()}
    assert [sorted({p.label for p in got[t].places}) for t in texts] == [["apache"], ["apache", "apache-2.0"], ["apache", "apache-2.0"]]
    with pytest.raises(ValueError, match="not in its template"):
        licenses.scan(rows, {}, {"x": ("one two three", ("two four",))}).collect()


def test_rules_as_a_table_judge_alike(spark, monkeypatch):
    pages = [f"http://{h}/{p}" for h in ("a.example.com", "x.net", "spam-farm.org", "b.org") for p in ("en/7", "de/8", "es/", "ads/x", "login")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*pages, None, "", "none", pages[0]])], "host int, url string")
    rules = (*urls.HOST_RULES, *urls.PATTERNS, urls.Rule("any x", "block", "x$", ()))
    want = sorted(map(tuple, urls.judge(pages, rules, "url").collect()), key=str)
    monkeypatch.setattr(urls, "INLINE", 3)
    assert sorted(map(tuple, urls.judge(pages, rules, "url").collect()), key=str) == want
    many = rules + tuple(urls.host_rule("block", f"host{i}.example.com/p/") for i in range(600))
    assert sorted(map(tuple, urls.judge(pages, many, "url").drop("n_candidates").collect()), key=str) == sorted(map(tuple, urls.judge(pages, rules, "url").drop("n_candidates").collect()), key=str)


def test_a_hot_id_is_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 32)
    monkeypatch.setattr(mixing, "BUNDLE", 4)
    docs = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", "IF(id < 1900, NULL, concat('s', id % 40)) AS source", "repeat('w ', CAST(id % 3 AS INT)) AS text")
    got = mixing.mixed(docs)
    rows = got.collect()
    assert len(rows) == 2000 and sorted(map(str, rows)) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
    own = docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), "text").groupBy("source", "digest").count().collect()
    assert max(r["count"] for r in own) > 600  # rows that nothing tells apart
    blocks = spark.range(2000).select(F.pmod(F.xxhash64(F.lit(None).cast("long"), F.lit(1), F.lit(7), F.expr("id div 4 * 4"), F.lit(0)), F.lit(63)).alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in blocks) < 32 * 4
    by = Counter()
    for r in rows:
        by[r.source] += r.taken
    for s in {r.source for r in rows}:
        assert abs(by[s] - next(r.target for r in rows if r.source == s)) <= 2 * max(r.size for r in rows if r.source == s)


def test_ranks_follow_code_points_over_partitions(spark):
    rng = random.Random(4)
    names = list({"".join(rng.choices("aZé€", k=rng.randint(1, 5))) for _ in range(300)}) + [None]
    rng.shuffle(names)
    got = mixing.ranked(spark.createDataFrame([(n, 1) for n in names], "source string, n long").repartition(5)).collect()
    want = sorted(names, key=lambda n: (n is None, (n or "").encode()))
    assert [r.source for r in sorted(got, key=lambda r: r.rank)] == want and sorted(r.rank for r in got) == list(range(1, len(names) + 1))


def _zip(note=b""):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for i in range(3):
            z.writestr(f"{i}.txt", b"some words" * i)
        z.comment = note
    return f.getvalue()


def _page(body, n, checked):
    page = b"OggS\0\0" + bytes(8) + b"\1\0\0\0" + struct.pack("<I", n) + bytes(4) + bytes([1, len(body)]) + body
    return page[:22] + struct.pack("<I", media._crc(page, 0x04C11DB7, 32)) + page[26:] if checked else page


#: A PNG up to its first chunk.
PNG_HEAD = b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + bytes(13) + struct.pack(">I", zlib.crc32(b"IHDR" + bytes(13)))


def _flac(frames):
    info = struct.pack(">HH", 192, 192) + bytes(6) + (44100 << 44 | 15 << 36 | 192 * frames).to_bytes(8, "big") + bytes(16)
    out = b"fLaC\0\0\0\x22" + info + b"\x84\0\0\x04abcd"
    for i in range(frames):
        head = b"\xff\xf8\x19\x08" + bytes([i])
        body = head + bytes([media._crc(head, 7, 8)]) + b"\0\x12\x34"
        out += body + struct.pack(">H", media._crc(body, 0x8005, 16))
    return out


def test_containers_own_their_bytes():
    plain, noted, wav = _zip(), _zip(b"a note"), media.wav(b"q" * 64)
    assert media.sniffed(plain) == ("zip", len(plain), 0, len(plain), [])
    assert media.sniffed(noted + b"--" + wav)[:2] == ("zip", len(noted)) and media.sniffed(noted + b"--" + wav)[4] == [("wav", len(noted) + 2, len(wav))]
    for checked in (True, False):
        pages = b"".join(_page(b"x" * 20, i, checked) for i in range(3))
        assert media.sniffed(pages + b"end") == ("ogg", len(pages), 0, len(pages), [])
    broken = _page(b"x" * 20, 0, True)[:-1] + b"y"
    assert media.sniffed(broken)[0] is None
    pdf = b"%PDF-1.4\nxref\nstartxref\n9\n%%EOF"
    twice = pdf + b"\n1 0 obj\nstartxref\n9\n%%EOF"
    assert media.sniffed(twice)[:2] == ("pdf", len(twice)) and media.sniffed(b"%PDF-1.4\n%%EOF\nmore\n%%EOF\n")[:2] == ("pdf", 25)
    assert media.sniffed(pdf + b"\n" + pdf)[4] == [("pdf", len(pdf) + 1, len(pdf))] and media.sniffed(b"%PDF-x" + pdf[8:])[0] is None
    flac = _flac(3)
    assert media.sniffed(flac + b"more" + wav) == ("flac", len(flac), 0, len(flac), [("wav", len(flac) + 4, len(wav))])
    assert media.sniffed(flac[:-1] + b"?")[0] is None and media.sniffed(b"fLaC looks like one" + wav)[4] == [("wav", 19, len(wav))]
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd" + b"data\xff\0data\xff\xd0data\xff\xd9"
    assert media.sniffed(jpeg + plain) == ("jpeg", len(jpeg), 0, len(jpeg), [("zip", len(jpeg), len(plain))])
    assert media.sniffed(media.bmp(b"z" * 64 + plain + bytes(-len(plain) % 64)))[4] == [("zip", 14 + 40 + 1024 + 64, len(plain))]


@pytest.mark.parametrize("unit", [b"%PDF-", b"%PDF-1.4 ", b"%PDF-1.4 %%EOF", b"PK\x03\x04", b"PK\x03\x04PK\x05\x06", b"\xff\xd8\xff\xda\0\x04ab", b"OggS\0", b"fLaC\0\0\0\x22", b"\x1f\x8b\x08", b"GIF89a", b"GIF89a\0\0\0\0\0\0\0,123456789", b"RIFF\x10\0\0\0WAVEfmt \0\0\0\0", b"RIFF\0\0\0\0WAVE", PNG_HEAD, PNG_HEAD + b"\0\x01\0\0", b"BM" + bytes(52), b"P5\n9 9\n255\n"])
def test_many_false_beginnings_take_linear_time(unit):
    def took(n):
        began = time.perf_counter()
        media.sniffed(unit * n)
        return time.perf_counter() - began

    took(1000)
    assert min(took(40_000) for _ in range(2)) < 12 * max(0.02, min(took(10_000) for _ in range(3)))


@pytest.mark.parametrize("few", [neardup.FEW if hasattr(neardup, "FEW") else 0, 5, 0])
def test_components_of_long_paths_hubs_and_loops(spark, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few, raising=False)
    rng = random.Random(4)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(400)]
    edges = [*zip(ids[:90], ids[1:91], strict=True), *((ids[100], x) for x in ids[101:220]), *((ids[300 + rng.randrange(60)], ids[300 + rng.randrange(60)]) for _ in range(50)), (ids[250], ids[250])]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()))
    want = {x: {x} for e in edges if e[0] != e[1] for x in e}
    for x, y in edges:
        if x != y and want[x] is not want[y]:
            want[x] |= want[y]
            for z in want[y]:
                want[z] = want[x]
    assert got.keys() == want.keys()
    assert {frozenset(x for x in got if got[x] == label) for label in got.values()} == {frozenset(x) for x in want.values()}
    assert neardup.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_rounds_of_contraction_write_few_files(spark, monkeypatch):
    """With many shuffle partitions and few links a run is bound by its writing tasks, a file each."""
    monkeypatch.setattr(neardup, "CROWD", 16)
    monkeypatch.setattr(neardup, "BLOCK", 32)
    made = []

    def written(df):
        made.append(_run.written(df))
        return made[-1]

    monkeypatch.setattr(neardup, "written", written)
    rng = random.Random(3)
    rows = []
    for i in range(240):
        w = [f"t{i % 4}.{k}" if i < 160 else f"p{k}" if k < 40 else f"v{i}.{k}" for k in range(80)]
        w[rng.randrange(80)] = f"u{i}"
        rows.append((i, " ".join(w)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected_components(rows)
    assert sum(len(df.inputFiles()) for df in made) <= 215


def test_variants_of_one_template(spark, monkeypatch):
    """Crowded postings of one template, some variants too far from the others, and of a passage that no two may be linked by."""
    monkeypatch.setattr(neardup, "CROWD", 16)
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rng = random.Random(1)
    rows = []
    for i in range(300):
        w = [f"t{k}" for k in range(80)]
        for k in rng.sample(range(80), rng.randint(0, 4)):
            w[k] = f"u{i}.{k}"
        rows.append((i, " ".join(w)))
    for i in range(300, 500):
        own = rng.randint(30, 60)
        rows.append((i, " ".join([*(f"p{k}" for k in range(80 - own)), *(f"v{i}.{k}" for k in range(own))])))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = expected_components(rows)
    assert len({c for *_, c in want}) > 205 and sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_kept_names_give_way_to_results(spark):
    docs = spark.createDataFrame([(1, "one two three", "kept", 7)], "doc_id long, text string, score string, n_words int")
    docs = docs.select("*", *(F.lit("old").alias(c) for c in ("row", "key", "_words", "_place", "_norm", "_hits", "_whole", "_text", "predicted", "lang_pred", "spans", "passages", "n_tokens", "media", "media_type", "declared", "host", "rule", "verdict")))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    every = docs.columns
    assert [r.score for r in quality.quality(docs, labels, *every).collect()] != ["kept"]
    assert toxicity.toxicity(docs, None, *every).head().n_words == 3
    assert langid.identify(docs, None, *every).head().lang_pred == "und"
    assert licenses.scan(docs, licenses.BASE, licenses.NOTICES, *every).head().n_words == 3
    assert tokencounts.with_tokens(docs, *every).head().n_tokens == 3
    stored = media.store(docs, *every)
    assert stored.head().declared != "old" and media.sniff(stored, "media", "declared", *stored.columns).head().media_type in ("wav", "bmp", "pgm")
    pages = docs.withColumn("url", F.lit("http://example.com/en/7"))
    assert urls.judge(pages, urls.HOST_RULES, *pages.columns).head().rule == "example.com/en/7"


def test_scratch_is_shared_and_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_run, "_MADE", [])
    monkeypatch.setattr(_run, "scratch", lambda spark: f"{tmp_path}/shared/{len(_run._MADE)}")
    assert _run.written(spark.range(3)).count() == 3 and len(list((tmp_path / "shared").iterdir())) == 1
    assert _run.cleared(spark) == 1 and not list((tmp_path / "shared").iterdir())


def test_chunked_formats_end_where_their_chunks_lead():
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    png = PNG_HEAD + chunk(b"IDAT", bytes(range(256)) * 200) + chunk(b"IDAT", b"ab") + chunk(b"IEND", b"")
    assert media.sniffed(png + b"rest")[:2] == ("png", len(png))
    assert media.sniffed(png[:20_000] + b"?" + png[20_001:])[0] is None and media.sniffed(png[:-1])[0] is None
    block = b"\x05abcde\0"
    gif = b"GIF89a\x01\0\x01\0\x80\0\0" + bytes(6) + b"!\xfe" + block + b",\0\0\0\0\x01\0\x01\0\0\x02" + block + b";"
    assert media.sniffed(gif + b"rest")[:2] == ("gif", len(gif)) and media.sniffed(gif[:-1])[0] is None
    odd = b"RIFF" + struct.pack("<I", 4 + 8 + 16 + 8 + 4 + 8 + 3 + 1) + b"WAVEfmt " + struct.pack("<I", 16) + bytes(16) + b"LIST\x04\0\0\0abcd" + b"data\x03\0\0\0xyz\0"
    assert media.sniffed(odd + b"rest")[:4] == ("wav", len(odd), len(odd) - 4, 3) and media.sniffed(odd[:-1])[0] is None
    rng = random.Random(3)
    b = rng.randbytes(60_000)
    for _ in range(40):
        x, y = sorted(rng.randrange(len(b)) for _ in range(2))
        assert media.Value(b).crc(x, y) == zlib.crc32(b[x:y])


def test_segments_of_a_long_text_take_linear_time():
    rng = np.random.RandomState(4)
    s = np.where(rng.rand(2_000_000) < 0.1, rng.rand(2_000_000) * 3, -rng.rand(2_000_000))
    began = time.perf_counter()
    for a in (s, np.abs(s) * np.where(np.arange(len(s)) % 3, -0.4, 1.0)):
        total = np.concatenate([[0], a.cumsum()])
        win = np.flatnonzero(a > 0)
        assert toxicity.segments(win, a[win], total[win])
    assert time.perf_counter() - began < 30


def test_a_repeated_labelled_id_is_learned_from_once(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 3000 + [(1, f"other {i}") for i in range(300)] + [(i, "") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] * 2, "doc_id long, quality int, toxic int")
    rows = _run.labelled(docs, labels, "quality", 10_000, 1 << 30).collect()
    assert len(rows) == len({(r.doc_id, r.text) for r in rows}) and sum(r.doc_id == 1 for r in rows) in (0, 301)
    for most, size in ((100, 1 << 30), (10_000, 900)):
        few = _run.labelled(docs, labels, "quality", most, size).collect()
        assert len(few) <= 2 * most and sum(len(r.text) for r in few) <= 2 * size + 100


def test_long_pieces_are_not_remembered():
    split, known = tokencounts._encoder(tokencounts.TOKENIZER)
    known.clear()
    assert known["x" * 5000] > 100 and len(known) == 0 and known["word"] >= 1 and len(known) == 1
