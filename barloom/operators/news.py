"""News: feed bodies, stories, classification, importance, impact.

Parsing and classification are expressions. Articles are gathered into stories within
a news cycle (a day by default): a cycle's articles are one group, in which an inverted
token index keeps the comparisons to stories that share a token. Stories are looked up
among all earlier ones block by block, each pair of blocks with such an index of its own.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numbers import clip, let
from barloom.sources.tables import stored

#: Words that tell stories apart by nothing, names of assets, rules and lexicons.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "than", "that", "this", "these", "those", "of", "in", "on", "at", "to", "for", "from", "by", "with", "without", "into", "over",
    "under", "about", "as", "is", "are", "was", "were", "be", "been", "being", "it", "its", "it's", "his", "her", "their", "our", "your", "my", "we", "they", "he", "she", "you", "i", "not",
    "no", "nor", "so", "such", "can", "could", "may", "might", "will", "would", "shall", "should", "must", "have", "has", "had", "do", "does", "did", "done", "new", "now", "here", "there",
    "what", "which", "who", "whom", "how", "why", "when", "where", "all", "any", "both", "each", "few", "more", "most", "other", "some", "only", "own", "same", "too", "very", "just", "also",
    "amid", "says", "say", "said", "report", "reports", "according",
)
ALIASES = {
    "BTC": ("btc", "bitcoin", "xbt"), "ETH": ("eth", "ethereum", "ether"), "SOL": ("sol", "solana"), "BNB": ("bnb", "binance coin"), "XRP": ("xrp", "ripple"),
    "ADA": ("ada", "cardano"), "DOGE": ("doge", "dogecoin"), "AVAX": ("avax", "avalanche"), "LINK": ("link", "chainlink"), "DOT": ("dot", "polkadot"),
}
AMBIGUOUS = ("link", "dot", "ada", "sol")
RULES = {
    "etf": ("etf", "exchange-traded fund", "spot etf", "etp"),
    "security_incident": ("hack", "hacked", "exploit", "breach", "stolen", "drained", "rug pull", "vulnerability", "attack", "compromised"),
    "enforcement": ("lawsuit", "sues", "sued", "charges", "indicted", "fined", "penalty", "settlement", "subpoena", "investigation", "probe", "sanctions"),
    "regulation": ("sec ", "regulator", "regulation", "regulatory", "cftc", "legislation", "bill", "congress", "senate", "mica", "compliance", "licence", "license"),
    "macro": ("federal reserve", "fed ", "fomc", "interest rate", "rate cut", "rate hike", "inflation", "cpi", "jobs report", "recession", "treasury yield", "gdp"),
    "exchange": ("exchange", "binance", "coinbase", "kraken", "okx", "bybit", "withdrawal", "outage", "halts trading", "delisting"),
    "protocol": ("upgrade", "hard fork", "mainnet", "testnet", "staking", "validator", "layer 2", "rollup", "consensus", "halving"),
    "listing": ("lists", "listing", "listed on", "trading pair"),
    "partnership": ("partnership", "partners with", "collaboration", "integrates", "teams up"),
    "adoption": ("adoption", "accepts crypto", "treasury", "institutional", "legal tender", "payment", "merchant"),
    "funding": ("raises", "funding round", "series a", "series b", "vc "),
    "market_move": ("price", "rally", "surge", "plunge", "crash", "all-time high", "ath", "correction", "liquidation", "sell-off"),
}
PRIOR = {
    "regulation": 0.75, "enforcement": 0.75, "etf": 0.80, "security_incident": 0.85, "exchange": 0.65, "protocol": 0.55, "partnership": 0.35, "adoption": 0.45,
    "macro": 0.70, "market_move": 0.30, "listing": 0.50, "funding": 0.25, "other": 0.20,
}
LEXICON = {
    "surge": 0.8, "surges": 0.8, "rally": 0.7, "rallies": 0.7, "soar": 0.9, "soars": 0.9, "jump": 0.6, "jumps": 0.6, "gain": 0.5, "gains": 0.5, "rise": 0.5, "rises": 0.5,
    "climb": 0.5, "climbs": 0.5, "approve": 0.8, "approved": 0.9, "approval": 0.8, "adoption": 0.6, "partnership": 0.5, "upgrade": 0.5, "launch": 0.4, "launches": 0.4,
    "record": 0.6, "high": 0.4, "bullish": 0.9, "breakout": 0.6, "accumulate": 0.5, "inflow": 0.6, "inflows": 0.6, "surged": 0.8, "milestone": 0.5, "optimism": 0.6,
    "boost": 0.6, "boosts": 0.6, "wins": 0.6, "won": 0.5, "success": 0.5, "green": 0.3, "recovery": 0.6, "rebound": 0.7, "surpasses": 0.6, "backing": 0.4, "surging": 0.8,
    "crash": -0.9, "crashes": -0.9, "plunge": -0.9, "plunges": -0.9, "plummet": -0.9, "fall": -0.5, "falls": -0.5, "drop": -0.5, "drops": -0.5, "decline": -0.5,
    "slump": -0.7, "tumble": -0.7, "tumbles": -0.7, "sink": -0.6, "sinks": -0.6, "hack": -0.9, "hacked": -0.9, "exploit": -0.8, "breach": -0.8, "stolen": -0.8,
    "lawsuit": -0.7, "sues": -0.6, "charges": -0.6, "fined": -0.7, "ban": -0.8, "banned": -0.8, "reject": -0.7, "rejected": -0.8, "rejection": -0.7, "delay": -0.5,
    "delayed": -0.5, "bearish": -0.9, "selloff": -0.8, "sell-off": -0.8, "fear": -0.6, "liquidated": -0.7, "liquidation": -0.6, "outflow": -0.6, "outflows": -0.6,
    "warning": -0.5, "warns": -0.5, "risk": -0.3, "concern": -0.4, "concerns": -0.4, "scam": -0.8, "fraud": -0.8, "collapse": -0.9, "bankruptcy": -0.9, "halt": -0.5,
    "halts": -0.5, "outage": -0.6, "downturn": -0.6, "correction": -0.4, "red": -0.3,
}
NEGATIONS = ("not", "no", "never", "without", "denies", "denied", "fails", "failed", "unlikely", "rules out", "refuses", "refused", "halts", "avoids")
OUTLET_SUFFIX = r"\s+[-|–—]\s+[a-z0-9 .']{2,30}$"
SAME_STORY = 0.30
FLOOR = 0.15
RECYCLED_HOURS = 36
#: Stories a block that asks for earlier ones (whole cycles), and known stories a block.
ASKING_A_BLOCK, KNOWN_A_BLOCK = 16_384, 65_536
NEGATION_REACH = 3


def clean_html(html: Column) -> Column:
    """Text of a fragment: tags dropped, the usual entities decoded, blanks collapsed."""
    text = F.regexp_replace(html, "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def feed_time(text: Column, default: Column) -> Column:
    """An RFC 822 or ISO 8601 time in UTC; without a zone it is UTC; else the default."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|UT)$", " +0000")
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")]
    return F.coalesce(*tries, F.try_to_timestamp(F.trim(text)), default)


def parse_feed(bodies: DataFrame, body: str = "body", source: str = "source", now: str = "now") -> DataFrame:
    """One row an item of RSS 2.0 or Atom bodies: source, title, url, published_at, summary. Bodies that aren't XML give none.

    Items are cut out as elements, so one broken item doesn't cost a feed its others.
    """
    items = F.regexp_extract_all(F.col(body), F.lit(r"(?s)<(item|entry)(?:\s[^>]*)?>(.*?)</\1>"), F.lit(2))
    rows = bodies.select(source, F.col(now).alias("_now"), F.explode(items).alias("_x"))
    tag = lambda *names: F.coalesce(*(F.nullif(F.trim(F.regexp_replace(F.regexp_extract("_x", rf"(?s)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")), F.lit("")) for n in names))
    link = F.coalesce(tag("link"), F.nullif(F.regexp_extract("_x", r'<link\s[^>]*href="([^"]*)"', 1), F.lit("")))
    out = rows.select(source, clean_html(tag("title")).alias("title"), link.alias("url"), feed_time(tag("pubDate", "dc:date", "published", "updated"), F.col("_now")).alias("published_at"), F.substring(clean_html(F.coalesce(tag("description", "summary", "content"), F.lit(""))), 1, 1200).alias("summary"))
    return out.where("title <> '' AND url IS NOT NULL")


def normal_title(title: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(title)), OUTLET_SUFFIX, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", " "), r"\s+", " "))


def title_tokens(title: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(normal_title(title), " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def title_shingles(title: Column, size: int = 2) -> Column:

    def grams(w):
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - size + 1)), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.array_distinct(F.when(F.size(w) < size, w).otherwise(pairs))

    return let(title_tokens(title), grams)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, both / F.size(F.array_union(a, b))).otherwise(0.0)


def token_weights(titles: DataFrame, title: str = "title") -> DataFrame:
    """token, df and weight: max(FLOOR, ln((N + 1) / (df + 1))) over the titles."""
    n = titles.agg(F.count("*").alias("n_titles"))
    df = titles.select(F.explode(F.array_distinct(title_tokens(F.col(title)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", F.greatest(F.lit(FLOOR), F.log((F.col("n_titles") + 1) / (F.col("df") + 1))).alias("weight"))


def _stories(pdf: pd.DataFrame) -> pd.DataFrame:
    """Oldest first, each article joins the most similar story so far, or begins one."""
    pdf = pdf.sort_values(["published_at", "item_id"], ignore_index=True)
    sets = [frozenset(t) for t in pdf["tokens"]]
    df = Counter(t for s in sets for t in s)
    weight = {t: max(FLOOR, math.log((len(sets) + 1) / (n + 1))) for t, n in df.items()}
    signature: list[set] = []
    mass: list[float] = []
    holders: dict[str, set[int]] = defaultdict(set)
    out = []
    for s in sets:
        if not s:
            out.append(None)
            continue
        shared: dict[int, float] = defaultdict(float)
        for t in sorted(s):
            for k in holders[t]:
                shared[k] += weight[t]
        own = sum(weight[t] for t in sorted(s))
        best, score = None, 0.0
        for k in sorted(shared):
            similar = shared[k] / (own + mass[k] - shared[k])
            if similar > score:
                best, score = k, similar
        if best is None or score < SAME_STORY:
            best = len(signature)
            signature.append(set())
            mass.append(0.0)
        for t in sorted(s - signature[best]):
            signature[best].add(t)
            holders[t].add(best)
            mass[best] += weight[t]
        out.append(best)
    pdf["story"] = pd.array(out, dtype="Int64")
    pdf["cycle_titles"] = len(sets)
    return pdf[pdf["story"].notna()][["cycle", "item_id", "story", "cycle_titles"]]


def stories(items: DataFrame, cycle: str = "day") -> DataFrame:
    """items (item_id, source, title, published_at) with cycle, story, the number of its story within the cycle, and cycle_titles; untold titles drop out."""
    keyed = items.withColumn("cycle", F.date_trunc(cycle, "published_at").cast("timestamp_ntz"))
    lean = keyed.select("cycle", "item_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"), F.array_distinct(title_tokens(F.col("title"))).alias("tokens"))
    told = lean.groupBy("cycle").applyInPandas(_stories, "cycle timestamp_ntz, item_id long, story long, cycle_titles long")
    return keyed.join(told, ["cycle", "item_id"])


def story_events(told: DataFrame) -> DataFrame:
    """One row a story: its id (hash of the first title), earliest, latest, outlets, coverage, the joined titles and the words of each article."""
    first = F.struct("published_at", "item_id")
    out = told.groupBy("cycle", "story").agg(
        F.min_by("title", first).alias("title"), F.min("published_at").alias("earliest"), F.max("published_at").alias("latest"),
        F.array_sort(F.collect_set("source")).alias("outlets"), F.count("*").alias("articles"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("published_at", "item_id", "title"))), lambda x: x["title"]), " ").alias("titles"),
        F.first("cycle_titles").alias("cycle_titles"), F.flatten(F.collect_list(F.array_distinct(title_tokens(F.col("title"))))).alias("words"),
    )
    return out.withColumn("cluster_id", F.substring(F.sha2(normal_title(F.col("title")), 256), 1, 16)).withColumn("coverage", F.size("outlets"))


def _boxed(**arrays) -> bytes:
    """Arrays of any lengths as one Arrow message, which passes through Spark as it is."""
    flat = [pa.array(x) for x in arrays.values()]
    batch = pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in flat], list(arrays))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unboxed(message: pa.Buffer) -> SimpleNamespace:
    """The arrays by name, numbers as numpy's."""
    batch = pa.ipc.open_stream(message).read_next_batch()
    values = {n: batch.column(n).flatten() for n in batch.schema.names}
    return SimpleNamespace(**{n: x if pa.types.is_string(x.type) else x.to_numpy() for n, x in values.items()})


def _whole(batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _coded(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, and of every token in lists its number and its list."""
    lists = lists.combine_chunks()
    tokens = lists.flatten().dictionary_encode()
    return tokens.dictionary, tokens.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()


def _micros(times: pa.ChunkedArray) -> np.ndarray:
    return times.cast(pa.int64()).to_numpy()


def _asking(batches):
    """A block of whole cycles: each one's token weights, and its stories with their distinct tokens."""
    t = _whole(batches)
    if t is None:
        return
    t = t.sort_by([("cycle", "ascending"), ("story", "ascending")])
    words, code, row = _coded(t["words"])
    at, n_words = _micros(t["earliest"]), max(1, len(words))
    cycles, cycle = np.unique(_micros(t["cycle"]), return_inverse=True)
    titles = t["cycle_titles"].to_numpy()[np.searchsorted(cycle, np.arange(len(cycles)))]
    used, df = np.unique(cycle[row] * n_words + code, return_counts=True)
    weight = np.maximum(FLOOR, np.log((titles[used // n_words] + 1) / (df + 1)))
    own = np.unique(row * n_words + code)
    block = _boxed(
        words=words, cycles=cycles, stories=np.bincount(cycle, minlength=len(cycles)), weights=np.bincount(used // n_words, minlength=len(cycles)), word=used % n_words, weight=weight,
        story=t["story"].to_numpy(), titled=t["cluster_id"].combine_chunks(), earliest=at, tokens=np.bincount(own // n_words, minlength=t.num_rows), token=own % n_words,
    )
    yield pa.record_batch([pa.array([block], pa.binary()), pa.array([at.max()], pa.int64())], ["asking", "newest"])


def _known(batches):
    """Blocks of known stories, oldest first: when each began, its first title's hash and its tokens."""
    t = _whole(batches)
    if t is None:
        return
    t = t.sort_by([("began", "ascending"), ("titled", "ascending")])
    for start in range(0, t.num_rows, KNOWN_A_BLOCK):
        part = t.slice(start, KNOWN_A_BLOCK)
        words, code, row = _coded(part["signature"])
        began = _micros(part["began"])
        block = _boxed(words=words, began=began, titled=part["titled"].combine_chunks(), tokens=np.bincount(row, minlength=part.num_rows), token=code)
        yield pa.record_batch([pa.array([block], pa.binary()), pa.array([began[0]], pa.int64())], ["known", "oldest"])


def _first_told(a: SimpleNamespace, k: SimpleNamespace, reach: int) -> list[tuple[int, int, int]]:
    """cycle, story and beginning of the first similar known story of those stories of a that have one in k, more than `reach` microseconds older.

    A story that is similar shares a word outside the commonest ones that make up less than SAME_STORY of the weight, so only the other words'
    holders are candidates; what a candidate shares is summed over all words.
    """
    n, stop = len(k.began), np.cumsum(k.tokens)
    start = stop - k.tokens
    holder = np.repeat(np.arange(n), k.tokens)[np.argsort(k.token, kind="stable")]
    end = np.cumsum(np.bincount(k.token, minlength=len(k.words)))
    held = [holder[i:j] for i, j in zip(np.concatenate([[0], end[:-1]]), end, strict=True)]
    often = np.diff(end, prepend=0)
    place = pc.fill_null(pc.index_in(a.words, value_set=k.words), -1).to_numpy()
    shared, weight = np.zeros(n), np.zeros(len(a.words))
    older = np.searchsorted(k.began, a.earliest - reach)
    own_stop, last_word, last_story, found = np.cumsum(a.tokens), np.cumsum(a.weights), np.cumsum(a.stories), []
    for c, cycle in enumerate(a.cycles.tolist()):
        stories = range(last_story[c] - a.stories[c], last_story[c])
        if not older[stories.start : stories.stop].any():
            continue
        used = slice(last_word[c] - a.weights[c], last_word[c])
        weight[a.word[used]] = a.weight[used]
        w, here = np.full(len(k.words), a.weight[used].max()), place[a.word[used]]
        w[here[here >= 0]] = a.weight[used][here >= 0]
        mass = np.add.reduceat(w[k.token], start)
        for i in stories:
            token = a.token[own_stop[i] - a.tokens[i] : own_stop[i]]
            own, at = weight[token], place[token]
            total = own.sum()
            at = at[at >= 0]
            at = at[np.argsort(-often[at], kind="stable")]
            asked = at[np.cumsum(w[at]) >= SAME_STORY * total * (1 - 1e-9)]
            if not older[i] or not len(asked):
                continue
            near = np.concatenate([held[x] for x in asked.tolist()])
            near = near[near < older[i]]
            if not len(near):
                continue
            for x in at.tolist():
                shared[held[x]] += w[x]
            both = shared[near]
            near = np.unique(near[both >= SAME_STORY * (total + mass[near] - both) * (1 - 1e-9)])
            for x in at.tolist():
                shared[held[x]] = 0.0
            for j in near.tolist():
                theirs = k.token[start[j] : stop[j]]
                same = np.isin(theirs, at)
                # Exact sums, so that a similarity doesn't depend on the order of words.
                if k.titled[j] != a.titled[i] and math.fsum(w[theirs[same]]) / math.fsum([*own, *w[theirs[~same]]]) >= SAME_STORY:
                    found.append((cycle, int(a.story[i]), int(k.began[j])))
                    break
    return found


def _compared(reach: int):
    def run(batches):
        for b in batches:
            found = [x for a, k in zip(b.column("asking"), b.column("known"), strict=True) for x in _first_told(_unboxed(a.as_buffer()), _unboxed(k.as_buffer()), reach)]
            cycle, story, began = zip(*found, strict=True) if found else ((), (), ())
            at = lambda x: pa.array(x, pa.int64()).cast(pa.timestamp("us"))
            yield pa.record_batch([at(cycle), pa.array(story, pa.int64()), at(began)], ["cycle", "story", "began"])

    return run


def recycled(events: DataFrame, hours: int = RECYCLED_HOURS) -> DataFrame:
    """events with recycled_from: when the first earlier story began that is similar and more than `hours` older.

    A story with the same first title isn't a re-telling but the same story, and doesn't count.

    Similarity is the Jaccard similarity of the stories' words by the later story's cycle's weights, at least SAME_STORY; a word that the
    cycle doesn't have weighs as much as its rarest. Stories are compared in blocks, whole cycles with known stories in the order of time, and
    a block's candidates stay in its task: only the first similar story leaves it.
    """
    events = stored(events)
    told = events.select("cycle", F.col("story").cast("long").alias("story"), "cluster_id", F.col("earliest").cast("timestamp_ntz").alias("earliest"), F.col("cycle_titles").cast("long").alias("cycle_titles"), "words").where("size(words) > 0")
    # Of equal signatures and first titles the oldest comes first in any case.
    known = told.groupBy(F.array_sort(F.array_distinct("words")).alias("signature"), F.col("cluster_id").alias("titled")).agg(F.min("earliest").alias("began"))
    n = told.count()
    asking = told.repartitionByRange(max(1, -(-n // ASKING_A_BLOCK)), "cycle").mapInArrow(_asking, "asking binary, newest long")
    known = known.repartitionByRange(max(1, -(-n // KNOWN_A_BLOCK)), "began").mapInArrow(_known, "known binary, oldest long")
    reach = hours * 3_600_000_000
    pairs = stored(asking).join(stored(known), F.col("oldest") + reach < F.col("newest"))
    first = pairs.select("asking", "known").mapInArrow(_compared(reach), "cycle timestamp_ntz, story long, began timestamp_ntz")
    first = first.groupBy("cycle", "story").agg(F.min("began").cast(events.schema["earliest"].dataType).alias("recycled_from"))
    return events.join(first, ["cycle", "story"], "left")


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    from functools import reduce

    return reduce(lambda a, b: a + b, (F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"\b{w}\b")) for w in words if w not in AMBIGUOUS))


def relevance(title: Column, body: Column) -> Column:
    """Array of (asset, score, mentions, in_title) of the assets that are named, highest score first."""
    found = []
    for asset, words in ALIASES.items():
        a, b = mentions(title, words), mentions(body, words)
        score = F.bround(F.least(F.lit(1.0), F.when(a > 0, 0.7).otherwise(0.0) + F.least(F.lit(0.3), b * 0.1)), 3)
        found.append(F.when(a + b > 0, F.struct((-score).alias("o"), F.lit(asset).alias("asset"), score.alias("score"), (a + b).alias("mentions"), (a > 0).alias("in_title"))))
    hits = F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return F.transform(hits, lambda x: F.struct(x["asset"].alias("asset"), x["score"].alias("score"), x["mentions"].alias("mentions"), x["in_title"].alias("in_title")))


def category(text: Column) -> Column:
    """The first rule of which a keyword occurs in the text, padded with blanks; `other` if none."""

    def first(padded):
        out = F.lit("other")
        for name, words in reversed(RULES.items()):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(padded, F.lit(w))
            out = F.when(hit, name).otherwise(out)
        return out

    return let(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), first)


def lexicon(text: Column) -> Column:
    """Struct (score, hits): the mean weight of the lexicon's words, turned by a negation up to three words before."""
    weights = F.create_map(*(F.lit(x) for p in LEXICON.items() for x in p))
    nots = F.array(*map(F.lit, NEGATIONS))

    def reading(w):
        # Most texts have few of the words: these are found by one hash set, then their places, and only from there one looks back.
        return let(F.array_intersect(w, F.array(*map(F.lit, LEXICON))), lambda own: let(places(w, own), lambda at: let(F.transform(at, lambda i: judged(w, i)), mean)))

    def places(w, own):
        marked = F.transform(w, lambda x, i: F.when(F.array_contains(own, x), i))
        return F.when(F.size(own) == 0, F.array().cast("array<int>")).otherwise(F.filter(marked, F.isnotnull))

    def judged(w, i):
        back = F.slice(w, F.greatest(F.lit(1), i + 1 - NEGATION_REACH), F.least(i, F.lit(NEGATION_REACH)))
        return F.struct(F.element_at(weights, F.get(w, i)).alias("v"), F.arrays_overlap(back, nots).alias("n"))

    def mean(hits):
        total = F.aggregate(hits, F.lit(0.0), lambda a, x: a + F.when(x["n"], -x["v"]).otherwise(x["v"]))
        return F.struct(F.when(F.size(hits) > 0, total / F.size(hits)).otherwise(0.0).alias("score"), F.size(hits).alias("hits"))

    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z\-]+)"), F.lit(1)), reading)


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.55, "very_positive").when(score >= 0.15, "positive").when(score <= -0.55, "very_negative").when(score <= -0.15, "negative").otherwise("neutral")


def classified(articles: DataFrame, coverage: str = "coverage", source_weight: str = "source_weight") -> DataFrame:
    """articles (title, body, coverage, source_weight) with category, relevance, sentiment, importance and confidence."""
    df = articles.withColumn("relevance", relevance(F.col("title"), F.col("body"))).withColumn("category", category(F.concat_ws(" ", "title", "body")))
    df = df.withColumn("_t", lexicon(F.col("title"))).withColumn("_b", lexicon(F.col("body")))
    t, b, hits = F.col("_t"), F.col("_b"), F.col("_t.hits") + F.col("_b.hits")
    mixed = F.when((t["hits"] > 0) & (b["hits"] > 0), t["score"] * 0.75 + b["score"] * 0.25).when(t["hits"] > 0, t["score"]).otherwise(b["score"])
    df = df.withColumn("_s", clip(mixed, -1, 1)).withColumn("sentiment", sentiment_label(F.col("_s"))).withColumn("sentiment_score", F.bround("_s", 3))
    prior = F.create_map(*(F.lit(x) for p in PRIOR.items() for x in p))[F.col("category")]
    breadth = F.when(F.col(coverage) > 0, F.least(F.lit(1.0), 0.35 + 0.22 * (F.col(coverage) - 1))).otherwise(0.35)
    named = F.coalesce(F.array_max(F.transform("relevance", lambda r: r["score"])), F.lit(0.35))
    strength = 0.6 + 0.4 * F.least(F.lit(1.0), F.abs("sentiment_score"))
    importance = F.bround(clip((prior * 0.40 + breadth * 0.30 + named * 0.15 + F.col(source_weight) * 0.15) * strength, 0, 1), 3)
    target = F.when(F.exists("relevance", lambda r: r["in_title"]), 1.0).when(F.size("relevance") > 0, 0.6).otherwise(0.3)
    sure = 0.25 + 0.75 * F.least(F.lit(1.0), hits / 4) * target * F.when(F.col("category") == "other", 0.4).otherwise(1.0)
    return df.withColumn("importance", importance).withColumn("confidence", F.bround(clip(sure, 0, 1), 3)).drop("_t", "_b", "_s")


def mood(events: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Sentiment of a key, weighted by importance times confidence, without recycled stories."""
    w = F.col("importance") * F.col("confidence")
    fresh = events.where("recycled_from IS NULL") if "recycled_from" in events.columns else events
    return fresh.groupBy(*key).agg((F.sum(F.col("sentiment_score") * w) / F.sum(w)).alias("sentiment"), F.count("*").alias("stories"))
