"""Near-duplicate detection by SuperMinHash signatures, banding, verification and components.

A document's set is its distinct 5-word shingles.  SuperMinHash gives each
element one random permutation of the signature's places and takes it rank by
rank: an element's value at its j-th place is j plus a random fraction.  Ranks of
an element are correlated, which lowers the variance of the estimate; and since
rank j + 1 cannot win where rank j or less has, a document stops at the first
rank by which all its places are filled, after a few ranks for long texts.

Bands of the signature give candidate buckets.  Each distinct set is one node, so
exact copies cost one row each, and an id with several texts has a node for each,
linked with one another.  For a few rounds each node is held against one centre of
its buckets (the node that a hash of the round puts first among those of another
component), so a round verifies and links at most one pair per node, and copies
that share all their buckets share one centre; components follow.  Then nodes that
share a bucket but not a component meet by the rarest shingles of their sets (a
prefix filter): in further rounds with central nodes of a shingle, more of them each
time, and what is still in different components pair by pair, so every candidate
pair is decided or already joined, and copies of one base that are all just below
the threshold cost no pairs.  Links are confirmed on full sets.
Components grow by large-star / small-star rounds.

A candidate pair must also pass a bound on the signature itself, kept as two bits
a place: as many mismatches as a pair at the threshold reaches with probability
below 1e-6 rule it out before it costs a row.  With 24 bands of 5 a pair at the
threshold of 0.85 is missed with probability (1 - 0.85^5)^24 by the bands, below
2e-6 with the bound.

Defined results: a text without words has an empty set and links with nothing;
fewer than five words make one shingle; rows with the same id are one document;
a row without an id links with nothing, its component is null and it is kept;
an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialframe.llm.common import map_batches, materialize, partitions_for, pick, slices
from dialframe.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 24, 5
THRESHOLD_PERCENT = 85
#: Members of one star that a task verifies; larger stars go to several.
STAR_ROWS = 512
#: Rounds of one centre per node before the remaining pairs.
STAR_ROUNDS = 2
#: Rounds of centres per node, by the shingles of its prefix: centres of a shingle, and those that a
#: node is held against.  Fewer nodes are left each time, and those need more.
TOKEN_ROUNDS = ((1, 4), (8, 16), (64, 64))
#: Cells that shingles are counted in for the order of the prefix filter.
ORDER_CELLS = 1 << 18
#: Probability that the sketch bound rules out a pair at the threshold.
MISSED = 1e-6
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (public splitmix constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _U(0x9E3779B97F4A7C15) + h[i:len(words) - size + 1 + i]
    return np.unique(_mix(out))


def signatures(sets: list[np.ndarray], places: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures, one row per (non-empty) set: rank in the high, fraction in the low 32 bits."""
    n = len(sets)
    best = np.full((n, places), np.iinfo(np.uint64).max, np.uint64)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    swaps: list[np.ndarray] = []
    for rank in range(places):
        if not len(element):
            break
        r = _mix(element + _U((rank + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        fraction, draw = r & _U(0xFFFFFFFF), r >> _U(32)
        k = rank + ((draw * _U(places - rank)) >> _U(32)).astype(np.int16)
        # The value at place k of the permutation after the earlier swaps (rank i with swaps[i]).
        place = k
        for i in range(rank - 1, -1, -1):
            place = np.where(place == swaps[i], np.int16(i), place)
        np.minimum.at(best, (of, place), (_U(rank) << _U(32)) | fraction)
        swaps.append(k)
        # Early stop: documents whose places are all filled can get no smaller value.
        open_ = (best == np.iinfo(np.uint64).max).any(1)[of]
        if not open_.all():
            element, of, swaps = element[open_], of[open_], [s[open_] for s in swaps]
    return best


def band_keys(best: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per document and band."""
    parts = best.reshape(len(best), bands, rows)
    key = np.zeros(parts.shape[:2], np.uint64)
    for i in range(rows):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def two_bits(best: np.ndarray) -> np.ndarray:
    """Two bits of each place, 32 places to a long: the sketch that pairs are bounded by."""
    bits = _mix(best) & _U(3)
    wide = -(-bits.shape[1] // 32) * 32
    bits = np.pad(bits, ((0, 0), (0, wide - bits.shape[1]))).reshape(len(best), -1, 32)
    return (bits << (_U(2) * np.arange(32, dtype=np.uint64))).sum(2, dtype=np.uint64).view(np.int64)


def most_mismatches(percent: int, places: int = BANDS * ROWS) -> int:
    """Mismatching places of the sketch that a pair at the threshold passes with probability below :data:`MISSED`."""
    p = 0.75 * (1 - percent / 100)
    tail = 1.0
    for k in range(places + 1):
        tail -= comb(places, k) * p ** k * (1 - p) ** (places - k)
        if tail < MISSED:
            return k
    return places


def _mismatches(x: str, y: str, longs: int = -(-BANDS * ROWS // 32)) -> str:
    """SQL: places where the sketches in the array columns x and y differ."""
    parts = (f"bit_count(({x}[{i}] ^ {y}[{i}] | shiftrightunsigned({x}[{i}] ^ {y}[{i}], 1)) & {0x5555555555555555}L)"
             for i in range(longs))
    return "(" + " + ".join(parts) + ")"


_SKETCH = "doc_id long, text_hash long, n_shingles long, set_key string, bands array<long>, bits array<long>"


def _sketch(n_bands: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_000_000):
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            best = signatures([sets[i] for i in full], n_bands * band_rows)
            keys, sketch = band_keys(best, n_bands, band_rows), two_bits(best)
            bands: list = [None] * len(sets)
            bits: list = [None] * len(sets)
            for row, i in enumerate(full):
                bands[i], bits[i] = keys[row], sketch[row]
            digest = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(digest, pa.string()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(bits, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "bands", "bits"])
    return run


def _verify(percent: int):
    """Streams rows sorted by star, its centre first, and keeps the members linked with the centre."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, np.zeros(0, np.uint64)
        for b in slices(batches, "text"):
            left, right = [], []
            for a, salt, member, node, text in zip(*(b.column(c).to_pylist() for c in
                                                     ("a", "salt", "member", "node", "text"))):
                own = shingle_set(text)
                if not member:
                    star, centre = (a, salt), own
                elif (a, salt) == star:
                    both = len(np.intersect1d(centre, own, assume_unique=True))
                    if 100 * both >= percent * (len(centre) + len(own) - both):
                        left.append(a)
                        right.append(node)
                else:
                    raise ValueError(f"star {a} has no centre")
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())],
                                             names=["a", "b"])
    return run


def verify(pairs: DataFrame, texts: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked; ``texts`` has one (node, text) row per node.

    A star around ``a`` is dealt to one task per :data:`STAR_ROWS` members, and a
    task holds two sets at a time.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("salts"))
    members = pairs.join(sizes, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"),
        F.col("b").alias("node"))
    centres = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                           F.lit(0).alias("member"), F.col("a").alias("node"))
    rows = members.unionByName(centres).join(texts, "node")
    dealt = (rows.select("a", "salt", "member", "node", "text")
             .repartition(partitions_for(rows.sparkSession), "a", "salt")
             .sortWithinPartitions("a", "salt", "member"))
    return map_batches(dealt, _verify(percent), "a long, b long")


def _lift(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links between nodes; those of ``labels`` are nodes of the new ones."""
    lifted = materialize(
        links.join(labels.withColumnsRenamed({"node": "a", "component": "la"}), "a", "left")
        .join(labels.withColumnsRenamed({"node": "b", "component": "lb"}), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), "minhash-lifted")
    higher = connected_components(lifted).select(F.col("node").alias("component"), F.col("component").alias("top"))
    first = labels.unionByName(lifted.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                               .join(labels, "node", "left_anti").withColumn("component", F.col("node")))
    return first.join(higher, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of a task's texts, counted by the low bits of their hash."""
    counts = np.zeros(ORDER_CELLS, np.int64)
    for b in slices(batches, "text"):
        found = [shingle_set(t) for t in b.column("text").to_pylist()]
        cells = np.concatenate(found) & _U(ORDER_CELLS - 1) if found else np.zeros(0, np.uint64)
        counts += np.bincount(cells.astype(np.int64), minlength=ORDER_CELLS)
    cell = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], names=["cell", "count"])


def _prefixes(percent: int, counts: np.ndarray):
    """The rarest shingles of each text that a similar set cannot all lack, with their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            of, tokens, places, short = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                own = shingle_set(text)
                n = len(own)
                probe, index = n + (-percent * n // 100) + 1, n + (-2 * percent * n // (100 + percent)) + 1
                own = own[np.lexsort((own, counts[(own & _U(ORDER_CELLS - 1)).astype(np.int64)]))][:probe]
                of.append(np.full(len(own), i))
                tokens.append(own.view(np.int64))
                places.append(np.arange(1, len(own) + 1))
                short.append(np.arange(len(own)) < index)
            if of:
                kept = b.select(["node", "n", "bits"]).take(pa.array(np.concatenate(of)))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, *(pa.array(np.concatenate(c)) for c in (tokens, places, short))],
                    names=["node", "n", "bits", "token", "place", "short"])
    return run


def _prefix_rows(held: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """A row per open node and shingle of its prefix.

    Shingles are ordered by how often the cell of their hash occurs in the open
    nodes (:data:`ORDER_CELLS` counts in all).  Copies that differ from a common
    base, each in its own way, begin with what is their own and meet nowhere.
    """
    rows = materialize(held.select("node", "n", "bits").dropDuplicates(["node"]).join(texts, "node"), "minhash-open")
    cells = (map_batches(rows.select("text"), _token_counts, "cell long, count long")
             .groupBy("cell").agg(F.sum("count").alias("count")).toArrow())
    counts = np.zeros(ORDER_CELLS, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("count").to_numpy()
    return materialize(map_batches(
        rows, _prefixes(percent, counts), "node long, n long, bits array<long>, token long, place long, short boolean"),
        "minhash-prefixes")


def _mixed_tokens(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    """The prefix rows of shingles whose nodes have several labels; ``minor`` where another label is more frequent."""
    held = (prefix.drop("label", "minor").join(labels, "node", "left")
            .withColumn("label", F.coalesce("component", "node")).drop("component"))
    several = (held.groupBy("token", "label").agg(F.count("*").alias("size")).groupBy("token")
               .agg(F.max_by("label", F.struct("size", "label")).alias("most"), F.count("*").alias("labels"))
               .where("labels > 1").select("token", "most"))
    return materialize(held.join(several, "token").withColumn("minor", F.col("label") != F.col("most")).drop("most"),
                       "minhash-mixed-tokens")


def _nearest_centres(held: DataFrame, fits: Column, mismatches: Column, percent: int, turn: int,
                     slots: int, most: int) -> DataFrame:
    """(a, b): for each node b up to ``most`` centres of its shingles, by the mismatches of their sketches.

    A hash deals the nodes of a shingle into ``slots``.  The centre of a slot is its
    node nearest to a pivot, which a hash of the round picks: of copies that differ
    from a common base, each in its own way, that is one near the base, and so near to most others.
    """
    order = F.xxhash64("node", F.lit(turn))
    pivots = held.groupBy("token").agg(
        F.min_by(F.struct("node", "bits"), F.struct(order, "node")).alias("pivot"))
    far = (held.join(pivots, "token").where("node != pivot.node").withColumn("bits_other", F.col("pivot.bits"))
           .withColumn("apart", mismatches).drop("pivot", "bits_other"))
    slot = F.pmod(F.xxhash64("node", F.lit(turn), F.lit("slot")), F.lit(slots)).alias("slot")
    centres = far.groupBy("token", slot).agg(
        F.min_by(F.struct("node", "n", "bits", "label", "place"), F.struct("apart", order, "node")).alias("centre"))
    pairs = held.join(centres, "token").where("label != centre.label").select(
        F.col("centre.node").alias("a"), F.col("node").alias("b"), "n", "bits", "place", F.col("centre.n").alias("n_other"),
        F.col("centre.bits").alias("bits_other"), F.col("centre.place").alias("place_a"))
    near = (pairs.where(F.expr(_room(percent)) & fits).withColumn("apart", mismatches)
            .groupBy("b", "a").agg(F.min("apart").alias("apart")))
    first = Window.partitionBy("b").orderBy("apart", F.xxhash64("a", F.lit(turn)), "a")
    return near.withColumn("nth", F.row_number().over(first)).where(f"nth <= {most}").select("a", "b")


def _room(percent: int) -> str:
    """SQL: the places of a pair's first shared shingle leave room for the overlap that a link needs."""
    return (f"(1 + least(n - place, n_other - place_a)) * {100 + percent} >= {percent} * (n + n_other)")


def _similar_pairs(held: DataFrame, fits: Column, percent: int) -> DataFrame:
    """(a, b): pairs of open nodes with unlike labels that may be linked, by a prefix filter on their sets.

    Of a similar pair the smaller set's short prefix and the other's prefix share
    a shingle, whatever the order; the places of the last shared one and how many
    are shared up to it bound the overlap.
    """
    index = held.where("short").select("token", F.col("node").alias("a"), F.col("n").alias("n_other"),
                                       F.col("bits").alias("bits_other"), F.col("label").alias("label_a"),
                                       F.col("place").alias("place_a"), F.col("minor").alias("minor_a"))
    probe = held.withColumnRenamed("node", "b")
    # Later shared shingles have less room: those that the bound of the first leaves out are its remainder.
    wanted = F.expr(f"label != label_a AND (n_other < n OR n_other = n AND a < b) AND {_room(percent)}")

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y, "token").where(wanted & fits).select("a", "b", "n", "n_other", "place", "place_a")

    # Nodes of a shingle's most frequent label need no pair with one another.
    return (pairs(index.where("minor_a"), probe).unionByName(pairs(index.where("not minor_a"), probe.where("minor")))
            .groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("n_other").alias("n_other"),
                                   F.max("place").alias("place"), F.max("place_a").alias("place_a"))
            .where(f"(shared + least(n - place, n_other - place_a)) * {100 + percent} >= {percent} * (n + n_other)")
            .select("a", "b"))


def _mixed(crowded: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The bucket rows with the labels of their nodes, of buckets whose nodes have several."""
    if labels is None:
        return crowded.withColumn("label", F.col("node"))
    held = (crowded.drop("label").join(labels, "node", "left")
            .withColumn("label", F.coalesce("component", "node")).drop("component"))
    several = (held.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
               .where("lo != hi").select("band", "key"))
    return materialize(held.join(several, ["band", "key"], "left_semi"), "minhash-mixed")


def _one_centre_each(held: DataFrame, fits: Column, turn: int) -> DataFrame:
    """(a, b): for each node b the first centre, by a hash of the round, that it could be linked with.

    The centre of a bucket is its first node by that hash.
    """
    place = F.xxhash64("node", F.lit(turn))
    centres = held.groupBy("band", "key").agg(
        F.min_by(F.struct("node", "n", "bits", "label"), F.struct(place, "node")).alias("centre"))
    pairs = held.join(centres, ["band", "key"]).where("label != centre.label").select(
        F.col("centre.node").alias("a"), F.col("node").alias("b"), "n", "bits",
        F.col("centre.n").alias("n_other"), F.col("centre.bits").alias("bits_other")).where(fits)
    return pairs.groupBy("b").agg(F.min_by("a", F.struct(F.xxhash64("a", F.lit(turn)), "a")).alias("a"))


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, doc_id: str = "doc_id",
                    text: str = "text", n_bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id = component_id).

    A pair at a similarity of s is missed by the bands with probability (1 - s^band_rows)^n_bands.
    """
    # The hash tells the texts of one id apart.
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64("text"))
    sketch = materialize(map_batches(rows, _sketch(n_bands, band_rows), _SKETCH), "minhash-sketch")
    known = sketch.where("doc_id is not null and set_key is not null")
    # One node per distinct set, numbered once: the numbers are those of the written table.
    nodes = materialize(
        known.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("owner"),
                                     F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
                                     F.first("bits").alias("bits"))
        .select(F.monotonically_increasing_id().alias("node"), "set_key", "owner.*", "n", "bands", "bits"),
        "minhash-nodes")
    buckets = nodes.select("node", "n", "bits", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    crowded = materialize(buckets.join(shared.select("band", "key"), ["band", "key"], "left_semi"), "minhash-buckets")
    # What a pair needs by its set sizes and sketches alone, before its sets are compared.
    places = n_bands * band_rows
    fits = F.expr(f"100 * least(n, n_other) >= {percent} * greatest(n, n_other) AND "
                  f"{_mismatches('bits', 'bits_other', -(-places // 32))} <= {most_mismatches(percent, places)}")
    owners = nodes.join(crowded.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash")
    texts = materialize(rows.join(owners, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]),
                        "minhash-texts")

    # The same id under several sets is one document.
    several = (known.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi"))
               .where("lo != hi").select("doc_id", "lo"))
    named = nodes.select("set_key", "node")
    links = (known.select("doc_id", "set_key").join(several, "doc_id").where("set_key != lo").select("lo", "set_key")
             .distinct().join(named.withColumnsRenamed({"set_key": "lo", "node": "a"}), "lo")
             .join(named.withColumnRenamed("node", "b"), "set_key").select("a", "b"))

    # A few rounds: each node against one centre of its buckets.  Between them a node's label is its centre.
    labels, held = None, crowded
    for turn in range(STAR_ROUNDS):
        held = _mixed(held, labels)
        found = materialize(verify(_one_centre_each(held, fits, turn), texts, percent), "minhash-links")
        links = links.unionByName(found)
        labels = found.select(F.col("b").alias("node"), F.col("a").alias("component"))
    labels = connected_components(links)

    # Then nodes of one bucket that are still in different components, by the shingles of their prefixes:
    # rounds of a few centres per node as long as they link, and the pairs that are left.
    held = _prefix_rows(_mixed(held, labels), texts, percent)
    apart = F.expr(_mismatches("bits", "bits_other", -(-places // 32)))
    for turn, (slots, most) in enumerate(TOKEN_ROUNDS):
        held = _mixed_tokens(held, labels)
        centres = _nearest_centres(held, fits, apart, percent, turn, slots, most)
        found = materialize(verify(centres, texts, percent), "minhash-links")
        if found.isEmpty():
            break
        labels = materialize(_lift(labels, found), "minhash-labels")
    cross = materialize(_similar_pairs(_mixed_tokens(held, labels), fits, percent), "minhash-pairs")
    labels = materialize(_lift(labels, verify(cross, texts, percent)), "minhash-labels")

    # A component is named by the smallest id of its nodes.
    member = nodes.select("set_key", "doc_id", "node").join(labels, "node", "left").select(
        "set_key", "doc_id", F.coalesce("component", "node").alias("component"))
    least = member.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = member.select("set_key", "component").join(least, "component").select("set_key", "least")
    found = sketch.join(named, "set_key", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
    return found.select("doc_id", "n_shingles", "component_id",
                        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
