"""Near copies for a corpus: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Shingles: words as in ``simhash``, each hashed by XXH64; a text of fewer words is one shingle, a text without words (or null) the empty set,
and empty sets are copies of each other.

Candidates, from two indexes:
  * SimHash: the fingerprints of the same shingles, within ``radius`` bits, by the Gray-order index of ``simhash``. At a similarity of 0.8 two
    fingerprints of 64 bits differ by about ten bits, for which that index would have to visit nearly all pairs, so it cannot find all of them.
  * BANDS keys of ROWS minimum hashes each, for the rest: a pair of similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS (0.99993 at 0.8, more above).

Every comparison is exact, over the whole sets. Texts with one key are a bucket. First each is compared with the bucket's leader, the member that
meets most others in its buckets, and similar ones are united. Then only pairs of different classes matter: if similar, the sets of
two such texts share one of their first shingles (all but as many as they have to share, and one more) in whatever common order. The order puts shingles last that four members of the bucket hold, so the first ones
of a text are its own, and few texts share them; where the first shared one stands bounds what the two can share at all. So a group of n
copies costs about n comparisons, a group of texts with one long passage too, and no comparison that matters is left out.

Defined results: as for ``simhash.one_of_each``: equal texts are one, a null doc_id is a row, an empty table gives an empty result, columns named like the ones used here stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import batch, bounded_batches, discard, materialize, tidy
from palimpsest.llm.simhash import LIMIT, RADIUS, SEED, components, first_of_each, local_links, majority, shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Members of a bucket whose pairs are compared without more ado.
FEW = 24

_RANDOM = np.random.default_rng(SEED)
_PERMUTE = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_JOIN = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_AT_ONCE = 512


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, as signed longs."""
    return np.unique(shingle_hashes(text, width)).view(np.int64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), _AT_ONCE):
        np.minimum(least, (_PERMUTE[:, None] * hashes[at : at + _AT_ONCE].view(np.uint64)).min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, fp (SimHash), n (distinct shingles), keys."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            fps, sizes, keys = [], [], []
            for text in b.column("text").to_pylist():
                hashes = shingle_hashes(text, width)
                found = np.unique(hashes).view(np.int64)
                fps.append(majority(hashes))
                sizes.append(len(found))
                keys.append(band_keys(found))
            yield batch(schema, doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), fp=np.array(fps, np.uint64).view(np.int64), n=sizes, keys=keys)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, text_hash long, fp long, n long, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, shingles, keys of the distinct texts whose hash is in wanted(id)."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            found = [shingles(t, width) for t in b.column("text").to_pylist()]
            yield batch(schema, id=b.column("id"), shingles=found, keys=[band_keys(x) for x in found])

    texts = docs.select(F.xxhash64("text").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")).mapInArrow(tidy(run), "id long, shingles array<long>, keys array<long>")


def _close(common: Column, union: Column, similarity: float) -> Column:
    return common + 1e-9 >= F.lit(similarity) * union


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b) whose sets are similar."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(right, "b").join(left, "a").withColumn("common", common).filter(_close(F.col("common"), F.size("x") + F.size("y") - F.col("common"), similarity)).select("a", "b")


def simhash_pairs(sketch: DataFrame, radius: int, limit: int) -> DataFrame:
    """a, b, an, bn: texts that the Gray-order index links, each with one text of its class; and texts of one fingerprint with the first of them."""
    texts = sketch.filter("n > 0").select("text_hash", "fp", "n").distinct()
    first = materialize(texts.groupBy("fp").agg(F.min(F.struct("text_hash", "n")).alias("x")), "first_of_fingerprint").select("fp", F.col("x.text_hash").alias("h"), F.col("x.n").alias("m"))
    one = first.select(F.bitwise_not("fp").alias("nf"), "h", "m")
    same = texts.join(one, (F.bitwise_not(texts.fp) == one.nf) & (texts.text_hash != one.h)).select(F.col("h").alias("a"), F.col("text_hash").alias("b"), F.col("m").alias("an"), F.col("n").alias("bn"))
    links = local_links(first.select("fp"), radius, limit)
    left, right = (first.select(F.col("fp").alias(f"{x}f"), F.col("h").alias(f"{x}h"), F.col("m").alias(f"{x}n")) for x in "ab")
    near = links.join(left, links.a == left.af).join(right, links.b == right.bf).select(F.col("ah").alias("a"), F.col("bh").alias("b"), "an", "bn")
    return same.unionByName(near)


def _grouped(docs: DataFrame, width: int, similarity: float, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """doc_id, text_hash, root (the least text hash of the component)."""
    sketch = materialize(sketches(docs, width), "sketches")
    sizes = lambda m, n: _close(F.least(m, n), F.greatest(m, n), similarity)
    by_simhash = materialize(simhash_pairs(sketch, radius, limit).filter(sizes(F.col("an"), F.col("bn"))).select("a", "b"), "simhash_pairs")
    members = sketch.groupBy("text_hash").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).select("text_hash", "n", F.explode(F.array_distinct("keys")).alias("key"))
    many = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select(F.bitwise_not("key").alias("nk"), "size")
    buckets = met_at = materialize(members.join(many, F.bitwise_not(members.key) == many.nk).select("key", "text_hash", "n", "size"), "buckets")
    met = buckets.groupBy("text_hash").agg(F.sum("size").alias("met")).select(F.bitwise_not("text_hash").alias("nh"), "met")
    buckets = buckets.join(met, F.bitwise_not(buckets.text_hash) == met.nh).select("key", "text_hash", "n", "met")
    leaders = buckets.groupBy("key").agg(F.max(F.struct("met", "text_hash", "n")).alias("l")).select(F.bitwise_not("key").alias("nk"), F.col("l.text_hash").alias("leader"), F.col("l.n").alias("leader_n"))
    first = buckets.join(leaders, F.bitwise_not(buckets.key) == leaders.nk).filter("text_hash <> leader").filter(sizes(F.col("n"), F.col("leader_n"))).select(F.col("leader").alias("a"), F.col("text_hash").alias("b"))
    buckets = buckets.drop("met")
    pairs = materialize(first.unionByName(by_simhash).distinct(), "first_pairs")
    wanted = buckets.select(F.col("text_hash").alias("id")).unionByName(pairs.select(F.col("a").alias("id"))).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = materialize(shingle_sets(docs, wanted, width), "shingle_sets")
    links = materialize(similar(pairs, sets, similarity), "links")
    roots = _named(components(links))
    discard(pairs, by_simhash)
    labelled = buckets.join(roots, F.bitwise_not(buckets.text_hash) == roots.nn, "left").select("key", "text_hash", "n", F.coalesce("root", "text_hash").alias("root"))
    labelled = materialize(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    mixed = mixed.select(F.bitwise_not("key").alias("nk"))
    unsized = materialize(labelled.join(mixed, F.bitwise_not(labelled.key) == mixed.nk, "left_semi"), "unsized")
    size = unsized.groupBy("key").agg(F.count("*").alias("size")).select(F.bitwise_not("key").alias("nk"), "size")
    open_ = materialize(unsized.join(size, F.bitwise_not(unsized.key) == size.nk).select("key", "text_hash", "n", "root", "size"), "open")
    fronts = front_shingles(open_.filter(F.col("size") > FEW), sets, similarity)
    rest = all_pairs(open_.filter(F.col("size") <= FEW), similarity).unionByName(first_shared(fronts, similarity)).distinct()
    more = materialize(similar(rest, sets, similarity), "more_links")
    discard(met_at, labelled, unsized, open_, fronts, sets)
    if not more.isEmpty():
        roots = _named(components(links.unionByName(more)))
    return sketch.join(roots, F.bitwise_not(sketch.text_hash) == roots.nn, "left").select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))


def all_pairs(few: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs of few(key, text_hash, n, root) with one key, different roots and sizes that may be similar. For buckets of FEW members at most."""
    left = few.select("key", F.col("text_hash").alias("a"), F.col("n").alias("an"), F.col("root").alias("ar"))
    right = few.select(F.bitwise_not("key").alias("nk"), F.col("text_hash").alias("b"), F.col("n").alias("bn"), F.col("root").alias("br"))
    may = (F.col("a") < F.col("b")) & (F.col("ar") != F.col("br")) & _close(F.least("an", "bn"), F.greatest("an", "bn"), similarity)
    return left.join(right, (F.bitwise_not(left.key) == right.nk) & may).select("a", "b").distinct()


def front_shingles(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of open_(key, text_hash, n, root) with keys, other (than the bucket's largest class), front (the first shingles), and each of these (at, shingle)."""
    seeds = [F.max(F.struct(F.xxhash64("text_hash", F.lit(i)).alias("r"), "text_hash")).alias(f"s{i}") for i in range(4)]
    some = open_.groupBy("key").agg(*seeds).select("key", F.explode(F.array_distinct(F.array(*[F.col(f"s{i}.text_hash") for i in range(4)]))).alias("id"))
    common = some.join(sets, "id").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("common")).select(F.bitwise_not("key").alias("nk"), "common")  # of four members
    main = open_.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("m")).select(F.bitwise_not("key").alias("mk"), F.col("m.root").alias("main"))
    least = open_.groupBy("key").agg(F.min("n").alias("least")).select(F.bitwise_not("key").alias("lk"), "least")
    rows = open_.join(common, F.bitwise_not(open_.key) == common.nk).join(main, F.bitwise_not(open_.key) == main.mk).join(least, F.bitwise_not(open_.key) == least.lk).join(sets.select(F.bitwise_not("id").alias("ni"), "shingles", "keys"), F.bitwise_not(F.col("text_hash")) == F.col("ni"))
    ordered = F.concat(F.array_sort(F.array_except("shingles", "common")), F.array_sort(F.array_intersect("shingles", "common")))
    #: What a similar one has to share, at least: of the smallest that can be similar and is there.
    needed = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.greatest(F.lit(similarity) * F.col("n"), F.col("least"))) - 1e-6)
    length = (F.col("n") - needed + 1).cast("int")
    rows = rows.select("key", "text_hash", "n", "root", "keys", (F.col("root") != F.col("main")).alias("other"), F.slice(ordered, F.lit(1), length).alias("front"))
    return materialize(rows.select("*", F.posexplode("front").alias("at", "shingle")), "front_shingles")


def first_shared(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs of front_shingles() with one key and different roots that may be similar, as their first shared shingle says."""
    #: One side of a pair of two classes is outside of the bucket's largest class.
    left = rows.filter("other").select("key", "shingle", F.struct("text_hash", "n", "root", "at", "front", "keys").alias("x"))
    right = rows.select(F.bitwise_not("key").alias("nk"), F.bitwise_not("shingle").alias("ns"), F.struct("text_hash", "n", "root", "at", "front", "keys", "other").alias("y"))
    x, y = F.col("x"), F.col("y")
    #: From the first shared shingle on, at most all that is left of the shorter rest is shared.
    shared = F.least(x["n"] - x["at"], y["n"] - y["at"])
    may = (x["root"] != y["root"]) & (~y["other"] | (x["text_hash"] < y["text_hash"])) & _close(shared, x["n"] + y["n"] - shared, similarity)
    #: A pair counts once: in the least bucket that both are in, at the first shingle that they share there.
    may = may & ~F.arrays_overlap(F.slice(x["front"], F.lit(1), x["at"]), F.slice(y["front"], F.lit(1), y["at"])) & (F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("key"))
    found = left.join(right, (F.bitwise_not(left.key) == right.nk) & (F.bitwise_not(left.shingle) == right.ns) & may)
    return found.select(F.least(x["text_hash"], y["text_hash"]).alias("a"), F.greatest(x["text_hash"], y["text_hash"]).alias("b")).distinct()


def _named(roots: DataFrame) -> DataFrame:
    """Of node, root: ~node and root of every text that is linked."""
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    return nodes.select(F.bitwise_not("node").alias("nn"), "root")


def one_of_each(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Of the rows of docs, with their columns, one for each component: the one with the smallest doc_id (a null only where all are), then text hash."""
    return first_of_each(docs, _grouped(docs, width, similarity))
