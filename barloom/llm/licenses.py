"""Licence scans with a positional rare-token index, in native functions only.

Templates are sequences of words. One pass over the corpus counts in how many
documents each template word occurs; a template is then posted, with relative
positions, under its rarest words. A document's occurrences of posted words are
looked up, each giving the place where the template would begin; a place that enough
posted words agree on is kept if the template's other words stand where they should
and if each of its mandatory key phrases stands whole at its own offset from that place;
a key phrase elsewhere in the text proves nothing.

A base phrase is posted under its single rarest word and must match word by word, so
that every place is found, and no other. A notice is posted under its ANCHORS rarest
words, two of which must agree, and SHARE of its words must be in place.

Defined cases: null and empty texts have no words and no labels; repeated rows get
equal results; other columns are ignored, kept ones named n_words or places give way to
the results; an empty table gives an empty result; ties of document frequency go to the
first word by code point; a key phrase that its template doesn't contain is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._run import kept, packed, table, unpacked

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Labels, notices and key phrases that must occur.
NOTICES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    "lgpl-3.0": ("licensed under the gnu lesser general public license version 3", ("lesser general public license", "version 3")),
    "mit-release": ("released under the mit license", ("under the mit license",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    "mpl-2.0": ("subject to the terms of the mozilla public license version 2 0", ("mozilla public license",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee", ("with or without fee",)),
    "all-rights-reserved": ("all rights reserved", ("all rights reserved",)),
}
ANCHORS = 3
SHARE = 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The words of a text, lower case, with single blanks between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _GAP, " "))


def _words(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of docs (text) each word of the vocabulary occurs; one row a word comes back."""
    held = F.array_intersect(_words(normal(F.col("text"))), F.array(*map(F.lit, vocabulary)))
    return dict.fromkeys(vocabulary, 0) | {r.word: r.n for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def offsets(words: list[str], phrases: tuple[str, ...]) -> list[int]:
    """Where a template has the words of its key phrases."""
    found = set()
    for phrase in phrases:
        own = phrase.split()
        at = next((i for i in range(len(words)) if words[i : i + len(own)] == own), None)
        if at is None:
            raise ValueError(f"not in its template: {phrase}")
        found |= set(range(at, at + len(own)))
    return sorted(found)


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, tuple[str, tuple[str, ...]]] = NOTICES, *keep: str) -> DataFrame:
    """The kept columns, n_words, places (template, first word, share in place) of docs (text), and base and all labels."""
    given, keep = kept(keep, "n_words", "places"), ["row"]
    docs = packed(docs, given, text=F.col("text"))
    templates = [(label, phrase.split(), ()) for phrase, label in base.items()] + [(label, text.split(), keys) for label, (text, keys) in notices.items()]
    n_base = len(base)
    often = document_frequency(docs, sorted({w for _, words, _ in templates for w in words}))
    postings: dict[str, list[tuple[int, int]]] = {}
    need = []
    for t, (_, words, _) in enumerate(templates):
        rare = sorted(set(words), key=lambda w: (often[w], w))[: 1 if t < n_base else ANCHORS]
        need.append(min(2, len(rare)) if t >= n_base else 1)
        for w in rare:
            at = [i for i, x in enumerate(words) if x == w]
            # all places of a repeated word are posted, but for a base phrase one is enough
            postings.setdefault(w, []).extend((t, i) for i in (at[:1] if t < n_base else at))

    def posted(pairs):
        return F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in pairs))

    anchors = F.array(*map(F.lit, sorted(postings)))
    index = F.create_map(*(x for w, pairs in sorted(postings.items()) for x in (F.lit(w), posted(pairs))))
    texts = F.array(*(F.array(*map(F.lit, words)) for _, words, _ in templates))
    keys = F.array(*(F.array(*map(F.lit, offsets(words, ks))).cast("array<int>") for _, words, ks in templates))  # of all words of the key phrases
    needs = F.array(*map(F.lit, need))
    names = F.array(*(F.lit(label) for label, _, _ in templates))

    rows = docs.select(*keep, normal(F.col("text")).alias("_norm"))
    rows = rows.select(*keep, F.inline(F.array(F.struct(_words(F.col("_norm")).alias("_words")))))
    seen = F.when(
        F.arrays_overlap("_words", anchors),
        F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(anchors, x["w"])),
    )
    place = F.flatten(F.transform(seen, lambda x: F.transform(F.element_at(index, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["i"]).alias("first")))))
    # Generate keeps the arrays below from being built again for each element that refers to them.
    rows = rows.select(*keep, "_words", F.inline(F.array(F.struct(F.array_sort(place).alias("_place")))))
    agreed = F.array_distinct(F.filter("_place", lambda p, i: (p["first"] >= 0) & ((F.element_at(needs, p["t"] + 1) == 1) | ((i > 0) & (F.get(F.col("_place"), i - 1) == p)))))
    rows = rows.select(*keep, "_words", F.inline(F.array(F.struct(agreed.alias("_place")))))

    def measured(p):
        own = F.element_at(texts, p["t"] + 1)
        fits = F.transform(own, lambda w, j: F.coalesce(F.get(F.col("_words"), p["first"] + j) == w, F.lit(False)))
        return F.struct(p["t"].alias("t"), p["first"].alias("first"), fits.alias("fits"))

    def judged(p):
        share = F.size(F.filter(p["fits"], lambda x: x)) / F.size(p["fits"])
        whole = F.forall(F.element_at(keys, p["t"] + 1), lambda j: F.get(p["fits"], j))
        return F.struct(p["t"].alias("t"), p["first"].alias("first"), share.alias("share"), whole.alias("whole"))

    rows = rows.select(*keep, "_words", F.inline(F.array(F.struct(F.transform("_place", measured).alias("_place")))))
    rows = rows.select(*keep, "_words", F.inline(F.array(F.struct(F.transform("_place", judged).alias("_place")))))
    enough = F.filter("_place", lambda p: F.when(p["t"] < n_base, p["share"] == 1).otherwise((p["share"] >= SHARE) & p["whole"]))
    enough = F.coalesce(enough, F.array().cast("array<struct<t:int,first:int,share:double,whole:boolean>>"))
    rows = rows.select(*keep, F.size("_words").cast("long").alias("n_words"), F.inline(F.array(F.struct(enough.alias("_place")))))
    found = F.transform("_place", lambda p: F.struct(F.element_at(names, p["t"] + 1).alias("label"), p["first"].cast("long").alias("first_word"), p["share"].alias("share"), (p["t"] < n_base).alias("is_base")))
    return unpacked(rows.select(*keep, "n_words", found.alias("places")), given, "n_words", "places")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"), BASE, NOTICES, "doc_id")
    base = F.filter("places", lambda p: p["is_base"])
    firsts = F.transform(base, lambda p: p["first_word"])

    def joined(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
