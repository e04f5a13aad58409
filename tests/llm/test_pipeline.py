"""The corpus pipeline against its stages applied by brute force."""

import re

import corpus_pipeline as p
from barloom.llm import toxicity
from barloom.llm._run import table
from barloom.llm.decontaminate import contained
from tests.llm import plain
from tests.llm.test_operators import expected_components


def test_each_stage_keeps_what_it_should(spark, sf):
    docs = table(spark, sf, "documents").withColumn("score", p.F.lit(1)).withColumn("row", p.F.lit("x")).cache()
    columns = docs.columns
    good = p.good_quality(spark, docs, sf)
    assert good.columns == columns
    rows, every, marks = good.collect(), docs.collect(), table(spark, sf, "labels").collect()
    order = dict(docs.select("text", p.F.xxhash64("text")).collect())
    scores = plain.quality_scores(every, marks, order)
    assert {r.doc_id for r in rows} == {r.doc_id for r, x in zip(every, scores, strict=True) if x >= 0.7} and len(rows) < len(every)
    clean = p.not_toxic(spark, good, sf)
    model = toxicity.train(good, table(spark, sf, "labels"))
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows if plain.toxic_score(r.text, model) < 0.3}
    single = p.no_near_copies(spark, docs, sf)
    want = {i for i, _, c in expected_components([(r.doc_id, r.text) for r in docs.collect()]) if i == c}
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(want)
    hit = {r.doc_id for r in contained(docs, table(spark, sf, "benchmark")).collect()}
    left = p.no_benchmark(spark, docs, sf)
    assert hit and left.columns == columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - hit
    mix = p.mix(spark, left, sf).collect()
    assert len(mix) == left.count() and all(r.taken <= 2 * r.size for r in mix)
    for source in {r.source for r in mix}:
        own = [r for r in mix if r.source == source]
        size = sum(len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in left.where(p.F.col("source").eqNullSafe(source)).collect())
        assert {r.source_size for r in own} == {size} and abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in own)


def test_the_whole_run(spark, sf):
    got = p.run(spark, sf).collect()
    assert 100 < len(got) < 200 and len({r.doc_id for r in got}) == len(got)


def test_null_ids_and_empty_tables(spark, sf):
    schema = table(spark, sf, "documents").schema
    odd = spark.createDataFrame([(None, "a b c d e f", None, None, None), (None, None, None, None, None), (7, "", None, None, 0)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in p.STAGES[:-1]:
            docs_out = stage(spark, docs, sf)
            assert docs_out.columns == docs.columns
            docs_out.count()


def test_null_and_repeated_ids_neither_lose_nor_shield_rows(spark, sf):
    schema = table(spark, sf, "documents").schema
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    item = table(spark, sf, "benchmark").where("size(split(text, ' ')) > 20").head().text
    texts = [(None, a), (None, a), (None, b), (5, b), (4, b + " end"), (7, c), (7, item), (None, item + " and more"), (None, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], schema).repartition(3)
    single = [(r.doc_id, r.text) for r in p.no_near_copies(spark, docs, sf).collect()]
    assert sorted(single, key=str) == sorted([(None, a), (4, b + " end"), (7, c), (7, item), (None, ""), (8, None)], key=str)
    left = [(r.doc_id, r.text) for r in p.no_benchmark(spark, docs, sf).collect()]
    assert sorted(left, key=str) == sorted([x for x in texts if item not in (x[1] or "")], key=str)
