"""Language of each word by a linear-chain conditional random field.

A word's emission scores are the summed weights of its hashed features: the word
itself (a learned lexicon), its first and last one to three bytes, and its byte pairs
and triples. As usual for such fields, a feature has a weight for each language that it
was seen with, so that weights grow with the training texts and not with the number of
languages. Learned transitions link neighbours: a weight of staying, of leaving and of
entering for each language, which takes time in proportion to their number.
Forward-backward gives every word a distribution over the languages; a text's language
is the one with the largest expected number of letters, its score that share.

Training texts come from a bounded sample (MAX_TRAIN_ROWS) outside the held-out fold,
named by their lang. Every language gets the same number of rows, or all that it has if
these are fewer, so that rare ones are learned too; beyond MAX_TRAIN_ROWS languages the
most frequent are. As each text has one language, training chains are spliced: runs of
words from different texts follow each other, so that the transitions learn how
often the language changes. Shards fit by adaptive gradient steps on the exact
log-likelihood, and their weights are averaged.

A text is one chain. Its pieces of CHAIN words run side by side; what a piece hands to
the next one is handed on again until nothing changes by more than SETTLED, which is the
recursion's own result, as it forgets where it began.

Defined cases: a null text, or one without any letter, is `und` with score 0;
repeated rows get equal results; rows with null lang or null doc_id aren't learned
from; without any learned language every text is `und`; other columns are ignored, kept
ones named like a result give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.llm._run import held_out, kept, packed, small_batches, table, unpacked, written
from barloom.llm._text import _BYTE, LETTER_WORDS, SLICE_BYTES, Words, mix, slices

BUCKETS = 1 << 16
MAX_TRAIN_ROWS = 6_000
ROWS_A_SHARD = 1_500
CHAIN = 64
EPOCHS = 2
CHAINS_A_STEP = 64
RATE = 0.3
RIDGE = 1e-5
SETTLED = 1e-12
#: Numbers in a table of words by languages that a task has at once.
CELLS = 1 << 21


@dataclass(frozen=True)
class Weights:
    """Weights by feature and language, in the order of the features."""

    first: np.ndarray  # of each bucket, BUCKETS + 1
    lang: np.ndarray
    w: np.ndarray

    def entries(self, bucket: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all weights of features, and whose (of) each feature is."""
        many = self.first[bucket + 1] - self.first[bucket]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[bucket], many)
        return at, np.repeat(of, many)

    def scores(self, bucket: np.ndarray, of: np.ndarray, n: int, k: int) -> np.ndarray:
        at, of = self.entries(bucket, of)
        return np.bincount(of * k + self.lang[at], self.w[at], n * k).reshape(n, k)


@dataclass(frozen=True)
class Moves:
    """Transition weights by language; step(i, j) is exp(leave i + enter j), or exp(stay i)."""

    stay: np.ndarray
    leave: np.ndarray
    enter: np.ndarray

    def ahead(self, a: np.ndarray) -> np.ndarray:
        u, v = np.exp(self.leave), np.exp(self.enter)
        return (a @ u)[:, None] * v + a * (np.exp(self.stay) - u * v)

    def back(self, b: np.ndarray) -> np.ndarray:
        u, v = np.exp(self.leave), np.exp(self.enter)
        return (b @ v)[:, None] * u + b * (np.exp(self.stay) - u * v)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    emit: Weights
    move: Moves


def word_types(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Type of each word, and the features of the types: buckets with the first position of each type."""
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    start, size = w.start[first], (w.end - w.start)[first]
    total = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(total[-1]) - np.repeat(total[:-1], size)
    byte = _BYTE[w.raw[inside + np.repeat(start, size)]]
    kind = np.repeat(np.arange(len(first)), size)
    left = np.repeat(size, size) - inside
    found, owner = [h[first]], [np.arange(len(first))]
    gram = byte.copy()
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x100000001B3) + byte[n - 1 :]
        full = left[: len(gram)] >= n
        begin, end = full & (inside[: len(gram)] == 0), full & (left[: len(gram)] == n)
        for salt, which in ((1, begin), (2, end), (3, full if n > 1 else None)):
            if which is not None:
                found.append(gram[which] * np.uint64(7) + np.uint64(11 * n + salt))
                owner.append(kind[: len(gram)][which])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bucket = (mix(np.concatenate(found))[order] % np.uint64(BUCKETS)).astype(np.int64)
    return of, bucket, np.searchsorted(owner[order], np.arange(len(first)))


def _unit(a: np.ndarray) -> np.ndarray:
    return a / a.sum(-1, keepdims=True)


def _forward(psi: np.ndarray, mask: np.ndarray, start: np.ndarray, move: Moves) -> np.ndarray:
    """What is known of each word from those before it; start is what comes in at the first word."""
    ahead = np.empty_like(psi)
    ahead[:, 0] = a = _unit(start * psi[:, 0])
    for t in range(1, psi.shape[1]):
        ahead[:, t] = a = np.where(mask[:, t, None], _unit(move.ahead(a) * psi[:, t]), a)
    return ahead


def _backward(psi: np.ndarray, mask: np.ndarray, end: np.ndarray, move: Moves) -> tuple[np.ndarray, np.ndarray]:
    """What is known of each word from those behind it, and what goes out before the first word."""
    back = np.empty_like(psi)
    back[:, -1] = b = end
    for t in range(psi.shape[1] - 1, 0, -1):
        back[:, t - 1] = b = np.where(mask[:, t, None], _unit(move.back(psi[:, t] * b)), b)
    return back, _unit(move.back(psi[:, 0] * b))


def _marginals(score: np.ndarray, mask: np.ndarray, move: Moves) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of separate chains (chains, length, languages): the words' distributions, and how often each language is expected to be stayed in, left and entered."""
    n, size, k = score.shape
    psi = np.exp(score - score.max(2, keepdims=True))
    ahead = _forward(psi, mask, np.ones((n, k)), move)
    back, _ = _backward(psi, mask, np.ones((n, k)), move)
    real = mask[:, 1:].reshape(-1)
    a, r = ahead[:, :-1].reshape(-1, k)[real], (psi * back)[:, 1:].reshape(-1, k)[real]
    into, out = move.ahead(a), move.back(r)
    z = (into * r).sum(1, keepdims=True)
    stay = a * np.exp(move.stay) * r / z
    return _unit(ahead * back), stay.sum(0), (a * out / z - stay).sum(0), (into * r / z - stay).sum(0)


def _fitted(langs: list[str]):
    k, place = len(langs), {x: i for i, x in enumerate(langs)}

    def run(batches):
        kinds, labels, seen = [], [], 0
        buckets, firsts, long = [], [], 0
        for b in batches:
            lang = np.array([place[x] for x in b.column("lang").to_pylist()], np.int64)
            for i, raw, offsets in slices(b.column("text")):
                w = Words(raw, offsets, LETTER_WORDS)
                if not len(w.start):
                    continue
                of, bucket, first = word_types(w, w.hashes())
                kinds.append(of + seen)
                labels.append(lang[i + w.text])
                firsts.append(first + long)
                buckets.append(bucket)
                seen, long = seen + len(first), long + len(bucket)
        if not seen:
            return
        kind, label, bucket, first = map(np.concatenate, (kinds, labels, buckets, firsts))
        count = np.diff(np.append(first, len(bucket)))

        # The weights that there are: features of word types with the languages that these were seen in.
        pair = np.unique(kind * k + label)
        features = np.repeat(first[pair // k], count[pair // k]) + np.arange(int(count[pair // k].sum())) - np.repeat(np.cumsum(count[pair // k]) - count[pair // k], count[pair // k])
        key = np.unique(bucket[features] * k + np.repeat(pair % k, count[pair // k]))
        emit = Weights(np.searchsorted(key, np.arange(BUCKETS + 1) * k), key % k, np.zeros(len(key)))
        move, grad = np.zeros((3, k)), np.full(len(key), 1e-3)
        grad_m = np.full((3, k), 1e-1)

        rng = np.random.RandomState(17)
        cut = np.sort(rng.choice(len(kind) + 1, size=max(2, len(kind) // 24), replace=True))
        runs = [r for r in np.split(np.arange(len(kind)), cut) if len(r)]
        most = min(CHAINS_A_STEP, max(1, CELLS // (CHAIN * k))) * CHAIN
        for _ in range(EPOCHS):
            word = np.concatenate([runs[r] for r in rng.permutation(len(runs))])
            for s in range(max(1, len(kind) // most)):
                own = word[s * most : (s + 1) * most]
                n = -(-len(own) // CHAIN)
                mask = np.arange(n * CHAIN) < len(own)
                own = np.append(own, np.zeros(n * CHAIN - len(own), np.int64))
                types, of = np.unique(kind[own], return_inverse=True)
                own_first = np.cumsum(count[types]) - count[types]
                at = np.arange(int(count[types].sum())) + np.repeat(first[types] - own_first, count[types])
                entry, row = emit.entries(bucket[at], np.repeat(np.arange(len(types)), count[types]))
                cell = row * k + emit.lang[entry]
                score = np.bincount(cell, emit.w[entry], len(types) * k).reshape(-1, k)[of]
                truth = label[own]
                p, *moved = _marginals(score.reshape(n, CHAIN, k), mask.reshape(n, CHAIN), Moves(*move))
                g = p.reshape(-1, k)
                g[np.arange(len(own)), truth] -= 1
                g[~mask] = 0
                by_type = np.zeros((len(types), k))
                np.add.at(by_type, of, g)
                used, which = np.unique(entry, return_inverse=True)
                ge = np.bincount(which, by_type.ravel()[cell]) / len(own) * CHAIN + RIDGE * emit.w[used]
                grad[used] += ge**2
                emit.w[used] -= RATE * ge / np.sqrt(grad[used])
                seq, real = truth.reshape(n, CHAIN), mask.reshape(n, CHAIN)[:, 1:]
                before, after = seq[:, :-1][real], seq[:, 1:][real]
                same = before == after
                known = [np.bincount(x, minlength=k) for x in (before[same], before[~same], after[~same])]
                gm = (np.array(moved) - known) / n
                grad_m += gm**2
                move -= RATE * gm / np.sqrt(grad_m)
        some = np.abs(emit.w) > 1e-4
        names = np.concatenate([key[some], -1 - np.arange(3 * k + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([emit.w[some], move.ravel(), [1.0]]))], ["key", "w"])

    return run


def stratified(known: DataFrame, most: int = MAX_TRAIN_ROWS) -> DataFrame:
    """At most about `most` rows of known (doc_id, lang, text): of each language equally many, or all; of more languages than rows the most frequent."""
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    low, high = 1, most
    while low < high:
        q = (low + high + 1) // 2
        low, high = (q, high) if sum(min(r.n, q) for r in counts) <= most else (low, q - 1)
    # First about twice as many by chance, then exactly the first ones of these; a language's group stays small.
    share = known.sparkSession.createDataFrame([(r.lang, min(1.0, (2 * low + 20) / r.n)) for r in counts], "lang string, share double")
    drawn = known.withColumn("turn", F.xxhash64("doc_id", F.monotonically_increasing_id())).join(F.broadcast(share), "lang")
    drawn = drawn.where(F.pmod("turn", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    return drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("turn"))).where(F.col("nth") <= low).select("doc_id", "lang", "text")


def train(docs: DataFrame) -> Model | None:
    """Learns from the texts whose lang isn't null, outside the held-out fold."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sample = written(stratified(known))
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())  # at most MAX_TRAIN_ROWS
    if not langs:
        return None
    k = len(langs)
    shards = max(1, min(4, sample.count() // ROWS_A_SHARD))
    rows = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)))
    fits = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id"), F.xxhash64("text")).select("lang", "text").mapInArrow(_fitted(langs), "key long, w double")
    parts = fits.groupBy("key").agg(F.sum("w").alias("w")).toPandas().sort_values("key")
    if not len(parts):
        return None
    key, w = parts.key.to_numpy(), parts.w.to_numpy()
    w = w / w[key == -1 - 3 * k][0]
    move = w[np.searchsorted(key, -1 - np.arange(3 * k))].reshape(3, k)
    key, w = key[key >= 0], w[key >= 0]
    return Model(langs, Weights(np.searchsorted(key, np.arange(BUCKETS + 1) * k), key % k, w), Moves(*move))


class _Chains:
    """The words of one slice in pieces of CHAIN words that follow each other within a text."""

    def __init__(self, w: Words, model: Model):
        self.of, self.bucket, self.first = word_types(w, w.hashes())
        self.count = np.diff(np.append(self.first, len(self.bucket)))
        self.model = model
        self.k = len(model.langs)
        pieces = -(-w.count // CHAIN)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text = np.repeat(np.arange(len(pieces)), pieces)
        self.begin = w.first[:-1][text] + nth * CHAIN
        self.long = np.minimum(CHAIN, w.count[text] - nth * CHAIN)
        self.opens, self.ends = nth == 0, nth == pieces[text] - 1
        self.parts = max(1, CELLS // (CHAIN * self.k))
        self.all = self._psi(np.arange(len(self.long))) if len(self.long) <= self.parts else None

    def _psi(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.arange(CHAIN) < self.long[part, None]
        words = np.where(mask, self.begin[part, None] + np.arange(CHAIN), self.begin[part, None])
        types, at = np.unique(self.of[words], return_inverse=True)
        n = self.count[types]
        features = np.arange(int(n.sum())) + np.repeat(self.first[types] - np.cumsum(n) + n, n)
        score = self.model.emit.scores(self.bucket[features], np.repeat(np.arange(len(types)), n), len(types), self.k)
        psi = np.exp(score - score.max(1, keepdims=True))
        return psi[at.reshape(words.shape)], mask

    def psi(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (self.all[0][part], self.all[1][part]) if self.all else self._psi(part)

    def split(self, pieces: np.ndarray):
        return np.split(pieces, range(self.parts, len(pieces), self.parts))

    def handed(self, forward: bool) -> np.ndarray:
        """What each piece gets from the one before it, or behind it."""
        n, move = len(self.long), self.model.move
        got, gives = np.full((n, self.k), 1 / self.k), np.full((n, self.k), 1 / self.k)
        outer = self.opens if forward else self.ends
        takes = np.flatnonzero(~outer)
        todo = np.unique(takes + (-1 if forward else 1))
        while len(todo):
            for part in self.split(todo):
                psi, mask = self.psi(part)
                if forward:
                    gives[part] = _unit(move.ahead(_forward(psi, mask, got[part], move)[:, -1]))
                else:
                    gives[part] = _backward(psi, mask, got[part], move)[1]
            new = gives[takes + (-1 if forward else 1)]
            moved = takes[np.abs(new - got[takes]).max(1) > SETTLED]
            got[takes] = new
            todo = moved[~(self.ends if forward else self.opens)[moved]]
        return got

    def distributions(self):
        """(first word, distributions of the words from there on) of each part, in order."""
        start, end = self.handed(True), self.handed(False)
        for part in self.split(np.arange(len(self.long))):
            psi, mask = self.psi(part)
            p = _unit(_forward(psi, mask, start[part], self.model.move) * _backward(psi, mask, end[part], self.model.move)[0])
            yield int(self.begin[part[0]]), p[mask]


def labelled(column: pa.Array, model: Model):
    """(first row, words, best language by word, expected letters by text and language) of each slice."""
    k = len(model.langs)
    for i, raw, offsets in slices(column, SLICE_BYTES // max(1, k // 64)):
        w = Words(raw, offsets, LETTER_WORDS)
        best, mass = np.zeros(len(w.start), np.int64), np.zeros((len(w.count), k))
        if len(w.start):
            for at, p in _Chains(w, model).distributions():
                best[at : at + len(p)] = p.argmax(1)
                text = w.text[at : at + len(p)]
                edge = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                mass[text[edge]] += np.add.reduceat(p * (w.end - w.start)[at : at + len(p), None], edge)
        yield i, w, best, mass


def identify(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The kept columns, lang_pred, score and spans (first word, last word, lang) of each row's text."""
    spark, keep = docs.sparkSession, kept(keep, "lang_pred", "score", "spans")
    found = packed(docs, keep, text=F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")))
    small_batches(spark)
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("lang", pa.string())]))
    schema = StructType([found.schema["row"]] + list(StructType.fromDDL("lang_pred string, score double, spans array<struct<first_word:long,last_word:long,lang:string>>")))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        mod = shared.value
        for b in batches:
            lang, score, spans = [], [], []
            if mod is None:
                lang, score, spans = ["und"] * b.num_rows, [0.0] * b.num_rows, [[]] * b.num_rows
            else:
                for _, w, best, mass in labelled(b.column("text"), mod):
                    total = mass.sum(1)
                    top = mass.argmax(1)
                    lang += [mod.langs[j] if t > 0 else "und" for j, t in zip(top, total, strict=True)]
                    score += [float(min(1.0, m[j] / t)) if t > 0 else 0.0 for m, j, t in zip(mass, top, total, strict=True)]
                    edge = np.ones(len(best), bool)
                    edge[1:] = (best[1:] != best[:-1]) | (w.text[1:] != w.text[:-1])
                    begin = np.flatnonzero(edge)
                    end = np.append(begin[1:], len(best))[: len(begin)] - 1
                    own: list[list] = [[] for _ in w.count]
                    for a, z in zip(begin, end, strict=True):
                        t = w.text[a]
                        own[t].append({"first_word": int(a - w.first[t]), "last_word": int(z - w.first[t]), "lang": mod.langs[best[a]]})
                    spans += own
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], schema.names)

    return unpacked(found.mapInArrow(run, schema), keep, "lang_pred", "score", "spans")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs.withColumn("text", F.lower("text"))), "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
