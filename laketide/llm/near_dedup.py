"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document is the set of its ``SHINGLE``-word shingles (A-Z lower-cased); a shorter text is one
shingle. Its sketch has ``BANDS * ROWS`` coordinates. In round i every element is thrown into one
coordinate by the i-th hash and offers (i, hash); the smallest offer stays, and later rounds only
matter for coordinates still empty. If ``T`` rounds leave some empty, round T + j offers all
elements to coordinate j, so every coordinate is filled. Two sketches agree in a coordinate with
the probability of their Jaccard similarity, with the concentration of independent draws, and a
sketch of n elements costs about n + T log T instead of n * T.

Documents with equal sets are one node, the one with the smallest id. Nodes that agree in a whole
band share a bucket. Links are found without all pairs of a bucket:

* shingles that no other candidate has bound every similarity from above: near copies with many
  changes of their own leave before any comparison, and others meet few partners;
* in a round, every node of a bucket is compared with one member, at first the one with the
  fewest shingles of its own, then one drawn anew: first the sketches, and if they agree nearly
  enough, the full sets; linked nodes become one component, and buckets
  inside one component are finished, so groups of near copies collapse here. Rounds go on while
  more pairs are left open than there are nodes and a round closes half of them, and end at ``STAR_ROUNDS``;
* then every pair of different components that the bound allows meets in the buckets of up to
  ``FEW`` members that it shares; its sketches are compared, and if they agree nearly enough, the
  full sets. Sketches travel as planes of bits, so a comparison is a few words of arithmetic in compiled code.
* Larger buckets are not taken pair by pair: there, what tells a member from the shingles common to
  its group is compared (see ``_meeting``), an exact filter that near copies just too different do not pass.

A pair with the similarity of 0.8 shares no band with probability (1 - 0.8**5)**40 = 1e-7, and its sketches look too different
about as rarely. Every
link is confirmed on the full sets.

Defined results: null or empty text has no shingles, no links and is kept. Rows of one id are one
document, with the links of each of their texts. Rows with a null id have a null component and
are kept, since nothing tells them apart.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laketide.llm.blocks import U, Block, blocks, mix, shingles, signed, text_bytes, word_hashes
from laketide.llm.common import drop_stored, packed, ship_code, stored
from laketide.llm.components import components

SHINGLE = 4
BANDS = 40
ROWS = 5
PERCENT = 80
STAR_ROUNDS = 8
PAIRS_PER_NODE = 1
#: Members of a bucket that are taken pair by pair after the star rounds.
FEW = 16
#: Pairs of texts that a task holds as Python values at a time.
SLICE_PAIRS = 128
#: Texts and sets that a task keeps for the pairs to come: a text of a large group meets many others.
HELD_BYTES = 16 << 20


def shingle_sets(block: Block, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(block)
    grams = shingles(words, k)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        else:
            sets.append(shingles(words[a:b], b - a) if b > a else np.zeros(0, dtype=U))
    return sets


def sketches(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of filled coordinates per set; empty sets stay at the largest value."""
    t = coordinates
    out = np.full((len(sets), t), np.iinfo(U).max, dtype=U)
    flat = out.reshape(-1)
    live = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    if not len(live):
        return out
    items = np.concatenate([sets[i] for i in live])
    owner = np.repeat(live, [len(sets[i]) for i in live])
    salts = mix(np.arange(1, 2 * t + 1, dtype=U))
    for r in range(2 * t):
        h = mix(items ^ salts[r])
        offer = (U(r) << U(40)) | (h & U((1 << 40) - 1))
        place = ((h >> U(40)) * U(t) >> U(24)).astype(np.int64) if r < t else np.full(len(items), r - t)
        np.minimum.at(flat, owner * t + place, offer)
        open_ = (out == np.iinfo(U).max).any(axis=1)
        keep = open_[owner]
        if not keep.any():
            break
        if not keep.all():
            items, owner = items[keep], owner[keep]
    return out


def _planes(low: np.ndarray) -> np.ndarray:
    """Bytes of coordinates as planes of bits: eight numbers, one for each bit, for every 64 coordinates."""
    n, t = low.shape
    padded = np.zeros((n, -(-t // 64) * 64), dtype=np.uint8)
    padded[:, :t] = low
    bits = (padded.reshape(n, -1, 1, 64) >> np.arange(8, dtype=np.uint8)[:, None]) & 1
    return np.packbits(bits, axis=-1).reshape(n, -1).view(np.int64)


def _emit_sketches(bands: int, rows: int, k: int):
    weights = mix(np.arange(1, rows + 1, dtype=U)) | U(1)

    def work(batches):
        for batch in batches:
            for block in blocks(text_bytes(batch.column(1), lower=True)):
                sets = shingle_sets(block, k)
                got = sketches(sets, bands * rows).reshape(len(sets), bands, rows)
                keys = mix((got * weights).sum(axis=2, dtype=U) + mix(np.arange(bands, dtype=U)))
                sums = [(int(s.sum(dtype=U)), int(np.bitwise_xor.reduce(mix(s), initial=0))) for s in sets]
                both = np.array(sums, dtype=U).reshape(-1, 2)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(signed(keys.reshape(-1))))
                low = _planes((mix(got) & U(255)).astype(np.uint8).reshape(len(sets), -1))
                digits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * low.shape[1]), pa.array(low.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(sets)), pa.array(n), pa.array(signed(both[:, 0].copy())), pa.array(signed(both[:, 1].copy())), lists, digits],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands", "digits"],
                )

    return work


def _bounds(texts: DataFrame, percent: int, k: int) -> DataFrame:
    """``node``, ``n`` (shingles) and ``a`` (those that another candidate has too) of the nodes that may have a link.

    Two nodes share at most min(a, a') shingles. Near copies with too many changes of their own
    so drop out, or meet only a few others, without being compared.
    """

    def work(batches):
        for batch in batches:
            for block in blocks(text_bytes(batch.column(1), lower=True)):
                sets = shingle_sets(block, k)
                size = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(sets)), size, pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], names=["node", "n", "grams"])

    one = texts.mapInArrow(work, "node long, n long, grams array<long>").select("node", "n", F.explode("grams").alias("gram"))
    shared = one.groupBy("gram").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("gram")
    have = one.join(shared, "gram", "left_semi").groupBy("node").agg(F.min("n").alias("n"), F.count("*").alias("a"))
    return have.where(100 * F.col("a") >= percent * F.col("n"))


def _possible(percent: int) -> Column:
    """Whether nodes (n, a) and (bn, ba) can reach the similarity: the intersection is at most the smaller of a and ba."""
    most = F.least("a", "ba")
    return 100 * most >= percent * (F.col("n") + F.col("bn") - most)


def _alike(coordinates: int, percent: int) -> Column:
    """Whether two sketches agree in so many coordinates (one byte kept of each) as a pair of the
    wanted similarity does but for 5.5 standard deviations."""
    p = percent / 100
    least = int(coordinates * p - 5.5 * (coordinates * p * (1 - p)) ** 0.5)
    differ = []
    for at in range(0, -(-coordinates // 64) * 8, 8):
        planes = [F.get("digits", F.lit(i)).bitwiseXOR(F.get("bdigits", F.lit(i))) for i in range(at, at + 8)]
        differ.append(F.bit_count(reduce(Column.bitwiseOR, planes)))
    return reduce(Column.__add__, differ) <= coordinates - least


def _meeting(many: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (node, b) of different components in large buckets (key, node, root, n, a) that may be linked; no link is lost.

    Buckets with common members are one family. Its base is the set of shingles that more than half
    of its texts have, and d(x) the set of shingles that only one of x and the base has. Texts x and y
    are linked if and only if s * |x - y| <= r * (|x| + |y|), with s = 100 + percent, r = 100 - percent
    and |x - y| = |d(x)| + |d(y)| - 2 * |d(x) & d(y)|. So with e(x) = s * |d(x)| - r * |x| they
    need e(x) + e(y) <= 2 * s * |d(x) & d(y)|. Where e(x) + e(y) <= 0, both are linked with the text of the
    smallest e, and meet it alone. All others must share so many entries of d that they share one of
    the rarest: of the first |d(x)| - (what x shares at least) + 1 by frequency in the family.
    """
    s, r = 100 + percent, 100 - percent

    def work(batches):
        for batch in batches:
            bases = batch.column(4)
            for block in blocks(text_bytes(batch.column(3), lower=True)):
                sets = shingle_sets(block, k)
                base = [bases[block.first + i].values for i in range(len(sets))]
                base = [np.zeros(0, U) if b is None else b.to_numpy().view(U) for b in base]
                got = [(np.setxor1d(x, b, assume_unique=True), len(x)) for x, b in zip(sets, base, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(block.first, len(sets)) for i in range(3)], pa.array([n for _, n in got], pa.int64()), pa.array([signed(d) for d, _ in got], pa.list_(pa.int64()))],
                    names=["family", "node", "t", "size", "d"],
                )

    edges = many.groupBy("key").agg(F.min("node").alias("lo")).join(many.select("key", "node"), "key").select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct()
    family = components(edges).select("node", F.col("root").alias("family"))
    units = stored(texts.join(family, "node").select("family", "node", F.xxhash64("text").alias("t"), "text"), "units")
    kind = "family long, node long, t long, size long, d array<long>"
    plain = units.withColumn("base", F.array().cast("array<long>")).mapInArrow(work, kind)
    common = plain.select("family", F.explode("d").alias("gram")).groupBy("family", "gram").agg(F.count("*").alias("c"))
    half = units.groupBy("family").agg((F.count("*") / 2).alias("half"))
    base = common.join(half, "family").where("c > half").groupBy("family").agg(F.collect_list("gram").alias("base"))
    own = units.join(base, "family", "left").select("family", "node", "t", "text", "base").mapInArrow(work, kind)
    of = many.select("node", "root", "n", "a").distinct()
    own = stored(own.withColumn("e", s * F.size("d") - r * F.col("size")).join(of, "node"), "units")
    drop_stored(units)

    first = own.groupBy("family").agg(F.min(F.struct("e", "node", "t", "root")).alias("x"))
    first = first.select("family", *[F.col(f"x.{c}").alias(f"{c}0") for c in ("e", "node", "t", "root")])
    core = (F.col("e") + F.col("e0") <= 0) | ((F.col("node") == F.col("node0")) & (F.col("t") == F.col("t0")))
    placed = own.join(first, "family").withColumn("core", core)
    beyond = placed.where("NOT core").groupBy("family").agg(F.min("e").alias("e1"))
    sure = placed.where("core AND root <> root0").select("node", F.col("node0").alias("b"))

    share = F.ceil((F.col("e") + F.when(F.col("core"), F.col("e1")).otherwise(F.col("e0"))) / (2 * s))
    asked = placed.join(beyond, "family").withColumn("depth", F.size("d") - share + 1).where("depth > 0")
    entries = own.select("family", "node", "t", F.explode("d").alias("gram"))
    often = entries.groupBy("family", "gram").agg(F.count("*").alias("f")).where("f > 1")
    # entries that no other text of the family has come first in the order and meet nobody
    ordered = entries.join(often, ["family", "gram"]).groupBy("family", "node", "t").agg(F.sort_array(F.collect_list(F.struct("f", "gram"))).alias("seen"))
    met = asked.join(ordered, ["family", "node", "t"]).withColumn("alone", F.size("d") - F.size("seen")).where("depth > alone")
    rare = F.posexplode(F.slice("seen", F.lit(1), (F.col("depth") - F.col("alone")).cast("int"))).alias("at", "entry")
    met = met.select("family", "node", "root", "n", "a", "e", (F.size("d") - F.col("alone")).alias("left"), rare)
    met = stored(met.select("family", F.col("entry.gram").alias("gram"), "node", "root", "n", "a", "e", (F.col("left") - F.col("at")).alias("left")), "met")
    other = met.select("family", "gram", *[F.col(c).alias(d) for c, d in (("node", "b"), ("root", "other"), ("n", "bn"), ("a", "ba"), ("e", "be"), ("left", "bleft"))])
    enough = 2 * s * F.least("left", "bleft") >= F.col("e") + F.col("be")
    near = met.join(other, ["family", "gram"]).where((F.col("node") < F.col("b")) & (F.col("root") != F.col("other")) & _possible(percent) & enough).select("node", "b")
    pairs = stored(sure.unionAll(near).distinct(), "pairs")
    drop_stored(own)
    drop_stored(met)
    return pairs


def similar(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    A node may have several texts (rows of one id); any of them may make the link.
    """
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def work(batches):
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def one(text: bytes) -> np.ndarray:
            nonlocal size
            if text not in held:
                if size > HELD_BYTES:
                    held.clear()
                    size = 0
                held[text] = shingle_sets(Block(0, [text]), k)[0]
                size += len(text) + held[text].nbytes
            return held[text]

        def rows(batch):
            for at in range(0, batch.num_rows, SLICE_PAIRS):
                part = batch.slice(at, SLICE_PAIRS)
                yield from zip(text_bytes(part.column(2), lower=True), text_bytes(part.column(3), lower=True), strict=True)

        for batch in batches:
            good = []
            for s, t in rows(batch):
                u, v = one(s), one(t)
                small, large = min(len(u), len(v)), max(len(u), len(v))
                if not small or 100 * small < percent * large:
                    good.append(False)
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(work, "a long, b long").distinct()


def groups(docs: DataFrame, **options) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` (``doc_id`` is the component's)."""
    return _grouped(docs, **options)[0]


def _grouped(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> tuple[DataFrame, list[DataFrame]]:
    """The groups, and the stored tables that they still read."""
    ship_code(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    kind = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, digits array<long>"
    sketched = stored(plain.mapInArrow(_emit_sketches(bands, rows, k), kind), "sketch")
    sets = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    sets = stored(sets, "sets")
    # an id with several different texts joins their sets
    several = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y"), F.count("*").alias("c")).where("c > 1 AND x <> y").select("doc_id")
    same = sketched.join(several, "doc_id").join(sets, ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    nodes = sketched.join(sets.select("s1", "s2", F.col("node").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi")
    buckets = nodes.select("doc_id", F.explode("bands").alias("key"))
    full = buckets.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    members = stored(buckets.join(full, "key").select("key", F.col("doc_id").alias("node")), "buckets")
    total = sets.count()
    close = members.select("node").distinct()
    texts = stored(plain.join(close.withColumnRenamed("node", "doc_id"), "doc_id").select(F.col("doc_id").alias("node"), "text").distinct(), "texts")

    bounds = stored(_bounds(texts, percent, k), "bounds")
    rest = stored(members.join(bounds, "node"), "members")
    drop_stored(members)
    digits = stored(nodes.join(bounds.select(F.col("node").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("node"), "digits"), "digits")
    alike = _alike(bands * rows, percent)
    links = stored(same.where("a <> b"), "links")
    none = docs.sparkSession.createDataFrame([], "node long, root long")
    roots = none if links.isEmpty() else stored(components(links), "roots")
    drop_stored(bounds)
    before = float("inf")
    for turn in range(STAR_ROUNDS + 1):
        named = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn:  # read twice, and the join may move every row
            named = stored(named, "members")
            drop_stored(rest)
            rest = named
        per_root = named.groupBy("key", "root").agg(F.count("*").cast("double").alias("c"))
        mixed = per_root.groupBy("key").agg(F.count("*").alias("k"), F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("k > 1")
        mixed = stored(mixed, "mixed")
        left = mixed.agg(F.sum((F.col("m") * F.col("m") - F.col("sq")) / 2).alias("p")).first()["p"] or 0
        if not left:
            break
        last = turn == STAR_ROUNDS or turn > 0 and (left <= PAIRS_PER_NODE * total or 2 * left > before)
        before = left
        # a bucket inside one component never opens again: later rounds read the rows left here
        open_ = stored(named.join(mixed.select("key", "m"), "key"), "members")
        drop_stored(rest)
        drop_stored(mixed)
        rest = open_.drop("root", "m")
        if last:
            few = open_.where(F.col("m") <= FEW).join(digits, "node")
            many = open_.where(F.col("m") > FEW)
            other = few.select("key", *[F.col(c).alias(d) for c, d in (("node", "b"), ("root", "other"), ("n", "bn"), ("a", "ba"), ("digits", "bdigits"))])
            likely = _possible(percent) & alike
            pairs = few.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("other")) & likely).select(F.col("node").alias("a"), "b")
            met = none.select("node", F.col("root").alias("b")) if many.isEmpty() else _meeting(many, texts, percent, k)
        else:
            # first the member with the smallest share of shingles of its own, then others
            draw = F.struct(F.when(F.lit(turn == 0), 1 - F.col("a") / F.col("n")).otherwise(0.0), F.xxhash64("node", F.lit(turn)))
            heads = open_.groupBy("key").agg(*[F.min_by(c, draw).alias(d) for c, d in (("node", "b"), ("root", "other"), ("n", "bn"), ("a", "ba"))])
            met = open_.join(heads, "key").where((F.col("root") != F.col("other")) & _possible(percent)).select("node", "b").distinct()
            pairs = none.select(F.col("node").alias("a"), F.col("root").alias("b"))
        # the sketches tell most pairs apart: only the others move their texts
        met = met.join(digits, "node").join(digits.select(F.col("node").alias("b"), F.col("digits").alias("bdigits")), "b").where(alike)
        pairs = pairs.unionAll(met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))).distinct()
        found = stored(similar(pairs, texts, percent, k), "found")
        links = links.unionAll(found)
        roots = stored(components(links), "roots")
        if last:
            break

    for done in (rest, texts, digits):
        drop_stored(done)
    named = sets.join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id")))
    decided = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    return decided, [sketched, sets]


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one document of every group.

    Of several rows with one id one stays, the first by the hash of its text; rows with a null id all stay.
    """
    decided, read = _grouped(docs, **options)
    decided = stored(decided, "groups")
    for done in read:
        drop_stored(done)
    gone = decided.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    many = decided.where("doc_id IS NOT NULL AND kept").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("__many"))
    row = docs.select(packed(docs).alias("row"))
    key = F.col("row.doc_id")
    kept = row.join(gone, key == F.col("__gone"), "left_anti")
    once = kept.join(many, key == F.col("__many"), "left_anti")
    repeated = kept.join(many, key == F.col("__many"), "left_semi").groupBy(key.alias("id")).agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row")
    return once.unionAll(repeated).select("row.*")
