"""Near-duplicate documents by a signature-coordinate inverted join.

Each distinct shingle set gets a MinHash signature of COORDINATES values. A set
is posted under its (coordinate, value) pairs; two sets with Jaccard similarity
of 0.75 collide in about 24 of the 32 pairs. Merging works like a T-occurrence
query over the postings:

* sets with equal shingles are one class, so copies never meet in a posting;
* pairs that only one class holds are skipped, and classes with fewer than
  MATCHES shared pairs leave: they can't reach the match threshold;
* prefix: of its m shared pairs a class posts only the m - MATCHES + 1 rarest,
  as two classes with MATCHES collisions must meet in one of those. A passage
  that a third of all documents hold sits in the part that isn't posted;
* skip: of each posting classes are first compared with its two ends only, one exact
  comparison a class, and what links is contracted to one component; classes of
  different components are then counted against each other, once, in the first
  posting that they share, lengths that can't reach the similarity being passed over;
* a posting of more than CROWD classes that is still in several components is
  contracted again and again with other ends, as long as that pays: variants of one
  template become one component in time linear in their number. What then is left of it
  is met in a sharper index, of shingles: similar sets share one of the rarest quarter
  of their shingles, by any one order of all shingles, and far enough in front in both.
  Documents that only share a passage, however many, don't meet there. Of a crowded
  posting of that index whole sets are compared block by block as matrix products,
  each giving a spanning forest of its links.

Every link is confirmed on the full shingle sets of both whole texts.

Losing a link needs fewer than 12 collisions of 32 at a probability of at least
0.75 each: less than two in a million for a pair exactly at the threshold. The index of
shingles loses none. Classes are keyed by two digests of 64 bits each.

Defined cases: null and empty texts, or texts without words, have no shingles and
link with nothing; texts of one to four words are one shingle; repeated rows are
copies; a row with null doc_id links others but is never kept; other columns are
ignored; an empty table gives an empty result. Rows that come with numbers are kept
by these: exactly one of each component, and each row that links with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._run import small_batches, table, written
from barloom.llm._text import mix, shingles, slices

COORDINATES = 32
MATCHES = 12
WORDS = 5
#: Classes in a posting that are still counted pair by pair.
CROWD = 64
BLOCK = 256
#: Columns in which the shingles of crowded classes are counted, to put them in order.
COUNTS = 1 << 20
PACKS = 64
#: Edges of a graph whose contraction is broadcast.
FEW = 100_000
#: Jaccard similarity of a link, in hundredths.
SIMILAR = 75

_RNG = np.random.RandomState(7)
_TURN = _RNG.randint(1, 2**62, size=COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_KEYS = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def _sketch(column: pa.Array) -> dict[str, np.ndarray]:
    """Per text: size of the shingle set, two order-free digests of it, its signature."""
    parts = []
    for _, raw, offsets in slices(column):
        v, _, n = shingles(raw, offsets, WORDS)
        k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        sig = np.zeros((len(n), COORDINATES), np.int32)
        some = n > 0
        if some.any():
            first = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            k1[some] = np.add.reduceat(mix(v * _KEYS[0]), first)
            k2[some] = np.add.reduceat(mix(v * _KEYS[1]), first)
            for i, a in enumerate(_TURN):
                sig[some, i] = np.minimum.reduceat((v * a >> np.uint64(32)).astype(np.uint32), first).view(np.int32)
        parts.append((n, k1.view(np.int64), k2.view(np.int64), sig))
    if not parts:
        return {"n": np.zeros(0, np.int64), "k1": np.zeros(0, np.int64), "k2": np.zeros(0, np.int64), "sig": np.zeros((0, COORDINATES), np.int32)}
    return {k: np.concatenate(x) for k, x in zip(("n", "k1", "k2", "sig"), zip(*parts, strict=True), strict=True)}


def _sketches(batches):
    for b in batches:
        s = _sketch(b.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(s["n"]) * COORDINATES + 1, COORDINATES), pa.int32()), pa.array(s["sig"].ravel()))
        own = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(s["n"].astype(np.int64)), pa.array(s["k1"]), pa.array(s["k2"]), lists], [*own, "n_shingles", "k1", "k2", "sig"])


def _rekeyed(batches):
    for b in batches:
        s = _sketch(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(s["k1"]), pa.array(s["k2"])], ["doc_id", "text", "k1", "k2"])


def _sets(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, raw, offsets in slices(column):
        v, _, n = shingles(raw, offsets, WORDS)
        out += np.split(v, np.cumsum(n)[:-1])
    return out


def _confirmed(batches):
    for b in batches:
        left, right = _sets(b.column("text_a")), _sets(b.column("text_b"))
        keep = []
        for x, y in zip(left, right, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both) > 0)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _set_rows(batches):
    for b in batches:
        sets = _sets(b.column("text"))
        size = np.array([len(x) for x in sets], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("cluster"), b.column("blocks"), lists], ["node", "cluster", "blocks", "shingles"])


def _forest(group: pa.Table) -> pa.Table:
    """A spanning forest of the links between two blocks, or within one block."""
    order = np.argsort(group.column("node").to_numpy(), kind="stable")
    node, block = group.column("node").to_numpy()[order], group.column("block").to_numpy()[order]
    lists = group.column("shingles").combine_chunks().take(pa.array(order))
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    value, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), size)
    _, col, many = np.unique(value, return_inverse=True, return_counts=True)
    place = np.cumsum(many > 1) - 1
    shared = many[col] > 1
    row, col = row[shared], place[col[shared]]
    cut = np.argsort(col, kind="stable")
    row, col = row[cut], col[cut]
    both = np.zeros((len(node), len(node)), np.float32)
    step = 4096
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        low, high = np.searchsorted(col, [c, c + step])
        part = np.zeros((len(node), step), np.float32)
        part[row[low:high], col[low:high] - c] = 1
        both += part @ part.T
    link = 100 * both >= SIMILAR * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, False)
    if block[0] != block[-1] or (block != block[0]).any():
        link &= block[:, None] != block[None, :]
    edges, seen = [], np.zeros(len(node), bool)
    for start in range(len(node)):
        if seen[start]:
            continue
        seen[start] = True
        todo = [start]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(link[i] & ~seen):
                seen[j] = True
                edges.append((node[i], node[j]))
                todo.append(j)
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table({"a": e.min(1) if len(e) else e[:, 0], "b": e.max(1) if len(e) else e[:, 1]})


def _crowded(hot: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the classes of crowded postings (node, token) link among themselves."""
    groups = components(hot.select(F.col("node").alias("a"), F.xxhash64("token", F.lit("posting")).alias("b")))
    own = groups.join(hot.select("node").distinct(), "node", "left_semi").withColumnRenamed("label", "cluster")
    sizes = own.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = texts.join(own, "node").join(sizes, "cluster").select("node", "cluster", "blocks", "text").mapInArrow(_set_rows, "node long, cluster long, blocks int, shingles array<long>")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "cluster", "block", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return rows.groupBy("cluster", "i", "j").applyInArrow(_forest, "a long, b long")


def _packed_counts(total: np.ndarray) -> pa.RecordBatch:
    """Counts of columns as one row for each COUNTS / PACKS neighbouring ones that has any."""
    some = np.flatnonzero(total)
    pack, first = np.unique(some // (COUNTS // PACKS), return_index=True)
    ends = pa.array(np.append(first, len(some)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(pack), pa.ListArray.from_arrays(ends, pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(total[some]))], ["pack", "at", "n"])


def _column_counts(batches):
    total = np.zeros(COUNTS, np.int64)
    for b in batches:
        for _, raw, offsets in slices(b.column("text")):
            total += np.bincount((shingles(raw, offsets, WORDS)[0] % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS)
    yield _packed_counts(total)


def _added(group: pa.Table) -> pa.Table:
    at, n = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "n"))
    return pa.Table.from_batches([_packed_counts(np.bincount(at, n, COUNTS).astype(np.int64))])


def _columns(texts: DataFrame) -> np.ndarray:
    """In how many of texts (text) each column has a shingle. Tasks add up among themselves before the driver gets COUNTS numbers at most."""
    kind = "pack long, at array<long>, n array<long>"
    parts = texts.select("text").mapInArrow(_column_counts, kind).withColumn("some", F.spark_partition_id() % 64)
    parts = parts.groupBy("pack", "some").applyInArrow(lambda g: _added(g), kind).groupBy("pack").applyInArrow(lambda g: _added(g), kind).toArrow()
    often = np.zeros(COUNTS, np.int64)
    often[parts.column("at").combine_chunks().flatten().to_numpy()] = parts.column("n").combine_chunks().flatten().to_numpy()
    return often


def _rest(hot: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the classes hot (node, label, n) of different labels link, found in an index of their shingles."""
    spark = hot.sparkSession
    rows = written(texts.select("node", "text").join(hot, "node"))
    shared = spark.sparkContext.broadcast(_columns(rows))

    def rarest(batches):
        for b in batches:
            at, value, place = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, raw, offsets in slices(b.column("text")):
                v, t, n = shingles(raw, offsets, WORDS)
                c = shared.value[(v % np.uint64(COUNTS)).astype(np.int64)]
                order = np.lexsort((v, c, t))
                v, c = v[order], c[order]
                rank = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)
                front = (rank <= n[t] - -(-SIMILAR * n[t] // 100)) & (c > 1)  # a column counted once holds a shingle that no other class has
                at.append(i + t[front])
                value.append(v[front])
                place.append(rank[front])
            at = pa.array(np.concatenate(at))
            own = [b.column(x).take(at) for x in ("node", "label", "n")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(value).view(np.int64)), pa.array(np.concatenate(place))], ["node", "label", "n", "token", "place"])

    posts = rows.mapInArrow(rarest, "node long, label long, n long, token long, place long")
    size = written(posts.groupBy("token").agg(F.count("*").alias("many"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token", "many"))
    posts = written(posts.join(size, "token"))
    a, b = posts.where(f"many <= {CROWD}").alias("a"), posts.where(f"many <= {CROWD}").alias("b")
    near = f"100 * least(a.n, b.n) >= {SIMILAR} * greatest(a.n, b.n)"
    far = f"{100 + SIMILAR} * least(a.n - a.place, b.n - b.place) >= {SIMILAR} * (a.n + b.n)"  # what is left can still be shared
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & F.expr(near) & F.expr(far))
    found = written(_links(pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), texts))
    crowd = posts.where(f"many > {CROWD}")
    return found if crowd.isEmpty() else found.unionByName(_crowded(crowd.select("node", "token"), texts))


def _links(pairs: DataFrame, texts: DataFrame, where=None) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the similarity, of those that meet a condition on sig_a and sig_b."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("text").alias("text_b")), "b")
    both = both if where is None else both.where(where)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the same label for the nodes of one component, for each node that has an edge.

    Every round contracts each node into its smallest neighbour, so the edges that
    are left shrink by a factor; ids that are hashes keep long paths from being in order.
    A round of few edges broadcasts its contraction, and so needs neither a table of it nor a shuffle of the edges.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    rounds = []
    while n := left.count():
        few = n <= FEW
        ends = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("end")).select("end.*")
        into = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        into = into if few else written(into)  # a table, so that a join with a hot node can be split
        rounds.append((into, few))
        moved = left.join(_small(into, few), "a").select(F.col("to").alias("x"), "b").join(_small(into.select(F.col("a").alias("b"), "to"), few), "b").select("x", F.col("to").alias("y"))
        moved = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = written(moved if few else moved.distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # From the last round back, so that each join is as small as its round.
    labels, small = rounds.pop()
    while rounds:
        into, few = rounds.pop()
        later = labels.select(F.col("a").alias("to"), F.col("to").alias("last"))
        labels, small = into.join(_small(later, small), "to", "left").select("a", F.coalesce("last", "to").alias("to")), few
    return written(labels.select(F.col("a").alias("node"), F.col("to").alias("label")))


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _relabelled(labels: DataFrame, to: DataFrame) -> DataFrame:
    """labels (node, label) with the label in to (node, label) of what was a label."""
    return written(labels.join(to.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after components that links (a, b) connect got one label."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    return _relabelled(labels, components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))))


def _star(posts: DataFrame, turn: int, texts: DataFrame) -> DataFrame:
    """Links of the classes in posts (token, node, n, label) with an end of one of their postings, in another component: one comparison a class."""
    key = F.struct(F.xxhash64("label", F.lit(turn)).alias("key"), F.xxhash64("node", F.lit(turn)).alias("own"), "node", "n", "label")
    ends = written(posts.groupBy("token").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low.label <> high.label"))  # a table, so that a hot posting can be split
    met = posts.join(ends, "token").select("node", "n", "label", F.explode(F.array("low", "high")).alias("end")).where("label <> end.label")
    met = met.where(f"100 * least(n, end.n) >= {SIMILAR} * greatest(n, end.n)")
    best = met.groupBy("node").agg(F.mode("end.node", True).alias("end"))
    star = best.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()
    return _links(star, texts, _collide("sig_a", "sig_b"))


def _collide(x: str, y: str):
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda p: p)) >= MATCHES


def _mixed(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """posts with label and many, the size of the posting; only postings of several components."""
    marked = posts.join(labels, "node")
    size = written(marked.groupBy("token").agg(F.count("*").alias("many"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token", "many"))
    return written(marked.join(size, "token"))


def near_duplicates(docs: DataFrame, number: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text).

    number names a column with a number of its own for each row. It is returned as
    `number`, and kept then marks the row of the smallest doc_id and number of each
    component, null ids last, so that one row stays whatever the ids are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = ["number"] if number else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(number).alias(n) for n in own))
    rows = written(docs.mapInArrow(_sketches, "doc_id long, " + "".join(f"{n} long, " for n in own) + "n_shingles long, k1 long, k2 long, sig array<int>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "number")).alias("first") if own else F.min("doc_id").alias("rep")
    classes = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(first, F.max("n_shingles").alias("n"), F.any_value("sig").alias("sig"))
    # A number of its own, scattered: the hash of a long is one to one.
    classes = classes.withColumn("node", F.xxhash64(F.monotonically_increasing_id()))
    classes = written(classes.withColumn("rep", F.col("first.doc_id")) if own else classes)

    # Postings that at least two classes share, and of each class the rarest ones that its prefix needs.
    tokens = classes.select("node", F.posexplode("sig").alias("at", "value")).select("node", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    often = written(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"))
    shared = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("shared"))
    prefix = shared.where(F.size("shared") >= MATCHES).select("node", F.expr(f"slice(shared, 1, size(shared) - {MATCHES - 1})").alias("prefix"))
    found = written(prefix.join(classes, "node"))
    posts = written(found.select("node", "n", F.explode("prefix.token").alias("token")))
    if own:
        texts = written(docs.join(found.select("node", "sig", F.col("first.number").alias("number")), "number").select("node", "sig", "text"))
    else:
        wanted = found.where("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct()
        some_null = docs.where("doc_id IS NULL")
        texts = docs.join(wanted, "doc_id", "left_semi").unionByName(some_null).mapInArrow(_rekeyed, "doc_id long, text string, k1 long, k2 long")
        texts = texts.groupBy("k1", "k2").agg(F.any_value("text").alias("text"))  # any text of a class has all its shingles
        texts = written(texts.join(found.select("node", "sig", "k1", "k2"), ["k1", "k2"]).select("node", "sig", "text"))

    # First the ends of each posting; crowded postings go on with other ends while a tenth of their classes finds a link.
    links = written(_star(posts.withColumn("label", F.col("node")), 0, texts))
    labels = _relabelled(found.select("node", F.col("node").alias("label")), components(links))
    mixed, turn, more = _mixed(posts, labels), 0, []
    while waiting := mixed.where(f"many > {CROWD}").select("node").distinct().count():
        turn += 1
        links = written(_star(mixed.where(f"many > {CROWD}"), turn, texts))
        if 10 * links.count() < waiting:
            more.append(links)  # too few to sort the postings again
            break
        labels = _joined(labels, links)
        mixed = _mixed(posts, labels)

    # Then what different components still share.
    crowd = mixed.where(f"many > {CROWD}").select("node", "label", "n").distinct()
    if waiting:
        more.append(written(_rest(crowd, texts)))
    held = written(mixed.where(f"many <= {CROWD}").join(found.select("node", "sig", F.col("prefix.token").alias("own")), "node"))
    a, b = held.alias("a"), held.select("token", F.col("node").alias("other"), F.col("n").alias("m"), F.col("label").alias("other_label"), F.col("sig").alias("other_sig"), F.col("own").alias("other_own"))
    once = F.array_min(F.array_intersect("own", "other_own")) == F.col("a.token")
    near = F.expr(f"100 * least(n, m) >= {SIMILAR} * greatest(n, m)")
    pairs = a.join(b, (F.col("a.token") == b["token"]) & (F.col("node") < F.col("other")) & (F.col("label") != F.col("other_label")) & near & _collide("sig", "other_sig") & once)
    last = written(_links(pairs.select(F.col("node").alias("a"), F.col("other").alias("b")), texts))
    for links in more:
        last = last.unionByName(links)
    if not last.isEmpty():
        labels = _joined(labels, last)

    least = "first" if own else "rep"
    of = classes.select("node", "k1", "k2", least).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = written(of)
    smallest = of.groupBy("label").agg(F.min(least).alias("component_id"))
    smallest = smallest.select("label", F.col("component_id.doc_id").alias("component_id"), F.col("component_id.number").alias("survivor")) if own else smallest
    smallest = written(smallest)  # a table, so that a join with a hot label can be split
    placed = of.join(smallest, "label").select("k1", "k2", "component_id", *(["survivor"] if own else []))
    out = rows.where("n_shingles > 0").join(placed, ["k1", "k2"]).unionByName(rows.where("n_shingles = 0"), allowMissingColumns=True)
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    kept = (F.col("n_shingles") == 0) | (F.col("number") == F.col("survivor")) if own else F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.select("doc_id", *own, "n_shingles", "component_id", kept.alias("kept"))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
