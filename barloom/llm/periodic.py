"""Periodic run detection by a sparse diagonal programme over words.

A word that equals the word q places before it lengthens the match on the diagonal of
lag q; a diagonal that ends after enough matches is a run of period q. Following every
earlier occurrence of a word costs the square of a common word's count, so a diagonal is
followed only where it can matter: for each context of k = 1, 2, 4, ... words that ends
at a word, the nearest earlier occurrence lengthens its diagonal if the lag lies in
(k/2, k]. That loses no run. In a run of smallest period q and four or more periods,
each context of q or more words that has a copy q places before it within the run has
no nearer one: a copy at d < q would give the run the period gcd(d, q) as well. So the
diagonal of q is fed without a gap over the whole run, and one that multiplies the
smallest period never. Contexts of 2k words are pairs of contexts of k words, and only
those that recur are carried on, so a text of n words takes about n log n steps and a few
integers a word, whatever repeats in it.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text;
repeated rows give equal rows; a null id is never planted; other columns are ignored, a
kept one named like a result gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.llm._run import kept, packed, small_batches, table, unpacked

#: A run has at least so many words and so many periods.
LEAST, TIMES = 6, 4


def numbered(words: list) -> np.ndarray:
    """The words as numbers, equal ones alike."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _recurring(name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts `name` that end at the ascending places `at`: places, new names and lags (0 for a first) of those that occur more than once."""
    order = np.argsort(name, kind="stable")
    ranked, place = name[order], at[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(order), bool)
    again[1:] = same
    again[:-1] |= same
    lag = np.zeros(len(order), np.int64)
    lag[1:][same] = (place[1:] - place[:-1])[same]
    new = np.cumsum(np.concatenate([[True], ~same])) if len(order) else order
    back = np.argsort(place[again])
    return place[again][back], new[again][back], lag[again][back]


def runs(name: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of numbers, by start, then period."""
    n, k, out = len(name), 1, []
    at, name, lag = _recurring(name, np.arange(n))
    while len(at) and k // 2 < n // TIMES:
        fed = (lag > k // 2) & (lag <= k)
        end, q = at[fed], lag[fed]
        if len(end):
            cut = np.flatnonzero((np.diff(end) != 1) | (np.diff(q) != 0))
            first, last = end[np.append(0, cut + 1)], end[np.append(cut, len(end) - 1)]
            q = q[np.append(0, cut + 1)]
            start = first - k + 1 - q
            long = last - start + 1
            full = long >= np.maximum(LEAST, TIMES * q)
            out += zip(start[full].tolist(), long[full].tolist(), q[full].tolist(), strict=True)
        # a context of 2k words: the context of k words that ends here, and the one that ends k words before
        found = np.searchsorted(at, at - k)
        paired = at[np.minimum(found, len(at) - 1)] == at - k
        at, name, lag = _recurring((name[found[paired]] << 32) + name[paired], at[paired])
        k *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without what repeats the first period of a run."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns of docs, n_words, runs (start, length, period) and the collapsed text."""
    small_batches(docs.sparkSession)
    own = StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    keep = kept(keep, *own.names)
    rows = packed(docs, keep, text=F.col(text))
    run = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def found(batches):
        for b in batches:
            size, spans, rest = [], [], []
            for raw in b.column("text").cast(pa.binary()):
                words = (raw.as_py() or b"").split()  # bytes split at \x20 and \x09 to \x0D, and nothing else
                got = runs(numbered(words)) if len(words) >= LEAST else []
                size.append(len(words))
                spans.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in got])
                rest.append(b" ".join(collapsed(words, got)).decode())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(size, pa.int64()), pa.array(spans, run), pa.array(rest, pa.string())], ["row", *own.names])

    return unpacked(rows.mapInArrow(found, StructType([rows.schema["row"], *own])), keep, *own.names)


def strongest(spans: Column) -> Column:
    """Of runs in their order, the first with the greatest length / period; null of none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.reduce(spans, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; by its id, a tenth of them repeat a few words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, words).alias("words"))
    rows = rows.select("*", F.size("words").cast("long").alias("n"), F.when(F.size("words") > 0, F.col("g") % F.size("words")).alias("a"))
    rows = rows.select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted(table(spark, sf_dir, "documents")), "doc_id").withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
