"""Near-duplicate documents by a signature-coordinate inverted join.

1. Each text becomes its set of distinct word shingles (64-bit hashes) and a MinHash signature of COORDINATES values.
   Texts with equal sets form one class; the class goes on under its smallest id.
2. Classes are posted under each (coordinate, value). Two sets of similarity s agree on about s * COORDINATES of
   them; pairs that agree on fewer than MATCHES are skipped. MATCHES lies so far below the expected count at the
   threshold that a linked pair falls short with a probability under one in 100,000 (prob_missed()).
3. Counting with prefixes and skips: a posting that no other class shares cannot count, so a class with more than
   COORDINATES - MATCHES such postings is skipped as a whole. Of the others only the rarest
   COORDINATES - MATCHES + 1 postings (the prefix) are merged, as a pair with MATCHES common postings shares one there.
4. A merged list is never expanded into pairs. Its members are held against one pivot (the smallest set), and where
   that does not link them all, against the member nearest to the pivot, which in a group of copies is the text they
   were made from. Components of these links leave stragglers, members outside their pivot's component. Only they meet
   their family's other members: in blocks of at most about BLOCK by BLOCK, first by counting common coordinates, and
   the likeliest first, as one link is enough to join two components. Blocks return links only.
5. Every link is confirmed on full sets. Links are merged into components by alternating stars.

No step collects a list in one task: pivots are aggregates, members meet them in joins that Spark may split, and blocks
are of bounded size. The blocks' work grows with stragglers times members of a family; nothing else is more than linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import Stages, release

COORDINATES = 64
#: Members of a block of comparisons, on either side.
BLOCK = 128
_RNG = np.random.RandomState(20240229)
_A = _RNG.randint(0, 2**63 - 1, COORDINATES, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.randint(0, 2**63 - 1, COORDINATES, np.int64).astype(np.uint64)
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def prob_missed(percent: int, matches: int) -> float:
    """Probability that a pair of exactly this similarity agrees on fewer coordinates than matches."""
    p = percent / 100
    return sum(math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k) for k in range(matches))


def least_matches(percent: int, missed: float = 1e-5) -> int:
    """The largest match threshold that loses pairs of this similarity with at most this probability."""
    return max(1, max((m for m in range(1, COORDINATES + 1) if prob_missed(percent, m) <= missed), default=1))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of the whole sequence if it has fewer words; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(31)))


def signature(own: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for start in range(0, len(own), 4096):
        np.minimum(least, (own[start : start + 4096, None] * _A + _B).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _features(docs: DataFrame, size: int, full: bool) -> DataFrame:
    """doc_id, n, d1, d2 (128-bit digest of the set), sig (coordinate << 32 | value), and own (the set itself) if full."""
    schema = "doc_id long, n int, d1 long, d2 long, sig array<long>" + ", own array<long>" * full

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    place = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                rows = batch.slice(start, 250)
                own = [shingles(t, size) for t in rows.column("text").to_pylist()]
                digest = [xxhash.xxh3_128_intdigest(o.tobytes()) for o in own]
                two = [np.array(x, np.uint64).astype(np.int64) for x in ([d >> 64 for d in digest], [d & 2**64 - 1 for d in digest])]
                sig = [signature(o) + place if len(o) else np.zeros(0, np.uint64) for o in own]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([len(o) for o in own], pa.int32()), *map(pa.array, two), lists(sig), *([lists([o.view(np.int64) for o in own])] * full)],
                    names=["doc_id", "n", "d1", "d2", "sig", *["own"] * full],
                )
        release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _linked(shared: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n + m - shared)


def components(stages: Stages, links: DataFrame) -> DataFrame:
    """(id, component): for each id in links (u, v) the smallest id that it is connected with; without those that are
    the smallest themselves. Alternating large and small stars, each round halving long paths."""
    edges = stages.put(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every pair of large has u > v; a node keeps its own least neighbour by them
        mid = stages.put(large.filter("u <> v").distinct())
        least = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        after = stages.put(small.filter("u <> v").distinct())
        stages.drop(edges, mid)
        edges = after


def _block_links(percent: int, matches: int):
    """Compares one block of a family's stragglers with one block of its members; see links_between()."""

    def run(key, rows):
        import pandas as pd

        found = []
        mine, theirs = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if len(mine) and len(theirs):
            sig = [np.vstack(x["sig"].to_list()) for x in (mine, theirs)]
            comps = [x["comp"].tolist() for x in (mine, theirs)]
            reps = [x["rep"].tolist() for x in (mine, theirs)]
            sets = [[np.asarray(o) for o in x["own"]] for x in (mine, theirs)]
            known: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := known.get(c, c)) != c:
                    c = up
                return c

            for i in range(len(mine)):
                agree = (sig[1] == sig[0][i]).sum(axis=1)
                for j in np.argsort(-agree, kind="stable").tolist():  # the likeliest first: one link joins two components
                    if agree[j] < matches:
                        break
                    one, two = root(comps[0][i]), root(comps[1][j])
                    if one == two:
                        continue
                    q, m = sets[0][i], sets[1][j]
                    both = len(np.intersect1d(q, m, assume_unique=True))
                    if 100 * both >= percent * (len(q) + len(m) - both):
                        known[two] = one
                        found.append((reps[0][i], reps[1][j]))
        return pd.DataFrame(found, columns=["u", "v"])

    return run


def links_between(stages: Stages, feats: DataFrame, lists: DataFrame, percent: int, matches: int) -> DataFrame:
    """Confirmed links among the members of lists (key, rep, n): enough to connect all that any links connect.

    feats: rep, sig, own (sorted shingles). Returns (id, component) as components() does; see step 4 above.
    """
    sets = feats.select("rep", "own")
    first = lists.groupBy("key").agg(F.min(F.struct("n", "rep")).alias("p")).select("key", F.col("p.rep").alias("p1"))
    family = lists.join(first, "key").filter("rep <> p1").select("p1", "rep").distinct()
    pairs = family.join(sets, "rep").join(sets.select(F.col("rep").alias("p1"), F.col("own").alias("other")), "p1")

    def measured(df: DataFrame) -> DataFrame:
        df = df.withColumns({"both": F.size(F.array_intersect("own", "other")), "n": F.size("own"), "m": F.size("other")})
        df = df.withColumn("linked", _linked(F.col("both"), F.col("n"), F.col("m"), percent))
        return df.withColumn("j", F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).drop("own", "other", "both", "n", "m")

    near = stages.put(measured(pairs))
    # families of more than a pair, not all of which is linked with the pivot: to the member nearest to it
    rest = near.groupBy("p1").agg(F.count(F.lit(1)).alias("k"), F.min("linked").alias("all"), F.max(F.struct("j", (-F.col("rep")).alias("r"))).alias("best"))
    rest = stages.put(rest.filter("k > 1 and not all").select("p1", (-F.col("best.r")).alias("p2")))
    second = near.join(rest, "p1").filter("rep <> p2").select("p2", "rep").distinct()
    pairs = second.join(sets, "rep").join(sets.select(F.col("rep").alias("p2"), F.col("own").alias("other")), "p2")
    nearer = stages.put(measured(pairs))
    links = near.filter("linked").select(F.col("rep").alias("u"), F.col("p1").alias("v"))
    links = stages.put(links.unionByName(nearer.filter("linked").select(F.col("rep").alias("u"), F.col("p2").alias("v"))).distinct())
    stages.drop(nearer)
    parts = components(stages, links)
    # the stragglers of each family: members that its pivots' component lacks
    rows = near.join(rest, "p1").select("p1", "p2", "rep")
    rows = rows.unionByName(rest.select("p1", "p2", F.col("p1").alias("rep")))
    comp = parts.select(F.col("id").alias("rep"), F.col("component").alias("c"))
    rows = rows.join(comp, "rep", "left").select("p2", "rep", F.coalesce("c", "rep").alias("comp"))
    rows = rows.join(comp.select(F.col("rep").alias("p2"), "c"), "p2", "left").select(F.coalesce("c", "p2").alias("key"), "rep", "comp").distinct()
    rows = stages.put(rows)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("comp") != F.col("key")).alias("out")).filter("out > 0 and k > 1")
    sizes = sizes.select("key", F.ceil(F.col("out") / BLOCK).cast("int").alias("nu"), F.ceil(F.col("k") / BLOCK).cast("int").alias("nm"))
    placed = rows.join(sizes, "key").join(feats, "rep")
    mine = placed.filter("comp <> key").withColumns({"side": F.lit(0), "i": F.pmod(F.xxhash64("rep"), F.col("nu")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("nm") - 1))})
    theirs = placed.withColumns({"side": F.lit(1), "j": F.pmod(F.xxhash64("rep"), F.col("nm")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("nu") - 1))})
    columns = ["key", "i", "j", "side", "rep", "comp", "sig", "own"]
    blocks = mine.select(columns).unionByName(theirs.select(columns))
    more = stages.put(blocks.groupBy("key", "i", "j").applyInPandas(_block_links(percent, matches), "u long, v long"))
    stages.drop(near, rest, rows)
    if more.isEmpty():
        return parts
    return components(stages, parts.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles (size of its set), component_id (the smallest id that it is
    connected with by links of similarity of at least percent / 100), kept (doc_id = component_id).

    docs needs doc_id and text; other columns are left out. Words are parted by ASCII space, A-Z count as a-z. A text
    of fewer than `size` words is one shingle. A null text or one without words links with nothing: its component_id
    is its own id. Repeated rows are alike, and rows of equal id but different texts are judged each by its text. A row
    without an id links with nothing, has no component_id, and is kept. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "minhash")
    matches = least_matches(percent)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    all_ = stages.put(_features(docs, size, full=False))
    some = all_.filter("n > 0 and doc_id is not null")
    classes = stages.put(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    reps = some.select("d1", "d2", F.col("doc_id").alias("rep"), "n", "sig").join(classes, ["d1", "d2", "rep"], "left_semi")
    postings = reps.select("rep", "n", F.explode("sig").alias("key"))
    shared = postings.join(postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "key")
    # at most COORDINATES postings come together here; those that nobody shares lead the prefix and are left out
    own = shared.groupBy("rep", "n").agg(F.array_sort(F.collect_set(F.struct("df", "key"))).alias("posts"))
    prefix = own.filter(F.size("posts") >= matches).select("rep", "n", F.explode(F.slice("posts", F.lit(1), F.size("posts") - matches + 1)).alias("p"))
    rows = stages.put(prefix.select(F.col("p.key").alias("key"), "rep", "n").distinct())
    lists = stages.put(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key"), "key"))
    stages.drop(rows)
    wanted = classes.join(lists.select("rep").distinct(), "rep")
    # the sets of those that are in a list, from their texts: less to move and store than the sets of all
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    feats = _features(texts, size, full=True).withColumnRenamed("doc_id", "rep")
    feats = stages.put(feats.join(wanted, ["d1", "d2", "rep"], "left_semi").select("rep", "sig", "own"))
    parts = links_between(stages, feats, lists, percent, matches)
    stages.drop(feats, lists)
    named = classes.join(parts, classes["rep"] == parts["id"], "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    rows = all_.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
