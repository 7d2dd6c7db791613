"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct runs of five words. Each register keeps the smallest of exponential values, one
for each member, as a whole power of a base near one, cut to a range; such registers can be merged by taking the larger
ones, and two sets agree in a register about as often as they overlap. Documents whose registers agree in a whole band
are candidates. For a pair of candidates the counts of greater, equal and smaller registers and both sizes give the
likelihood of every overlap; only pairs whose likeliest overlap is near the threshold or above are compared, on their full
sets.

Work. Documents of equal sets form a class, of which only one goes on. Buckets of equal members are kept once. At
first each class goes to its largest bucket only, and to one block of bounded size there; links found inside blocks join classes into
components. One member of each component then goes on to fewer blocks, until these join nothing more. Then only buckets
that still hold several components are gone through in full, and only pairs across components: a pair inside a component can't
change the result. The largest component's blocks are compared with the others' blocks there and not with each other, so a
group of near copies is neither written out as pairs nor copied to pairs of blocks: what is placed grows with its size.

Chance. At the threshold of 0.85 a pair meets in none of 22 bands of 5 registers once in 400,000; for other thresholds the
bands are chosen for the same chance. No cap or sample is involved.

Edge cases: a null or empty text, or one of white space, has an empty set and is linked with nothing; a text of
fewer than five words has its whole sequence as the only member; rows of equal id count as one document in links; a row
without id is linked with nothing and its component is null; an empty table gives no rows. Columns other than ``doc_id``
and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boletim.llm.common import fresh, packed, steps, written
from boletim.llm.components import components
from boletim.llm.words import PLACES, mix, split_words, window_hashes

#: Words in a member; percent of the union that must be shared.
WIDTH = 5
PERCENT = 85
#: Base of the powers, rate of the exponential values and largest register.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Documents and bytes of sets in a block.
BLOCK_ROWS = 400
BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class Scheme:
    """What a threshold in percent takes: bands of rows, and from where pairs are looked at closer."""

    percent: int
    bands: int
    rows: int

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def deviation(self) -> float:
        """Of the share of equal registers at the threshold."""
        share = self.percent / 100
        return float(np.sqrt(share * (1 - share) / self.registers))

    @property
    def least_equal(self) -> int:
        """Equal registers from which the likelihood is worked out: six deviations below the mean at the threshold."""
        return int(self.registers * (self.percent / 100 - 6 * self.deviation))

    @property
    def look_from(self) -> float:
        """Likeliest overlap from which a pair is compared, as a share: four and a half deviations below the threshold."""
        return self.percent / 100 - 4.5 * self.deviation


def scheme(percent: int) -> Scheme:
    """Bands in none of which a pair at the threshold meets once in 400,000 at most."""
    rows = 5 if percent >= 85 else 4 if percent >= 80 else 3
    return Scheme(percent, int(np.ceil(np.log(1 / 399_000) / np.log1p(-((percent / 100) ** rows)))), rows)


_SCHEME = scheme(PERCENT)
REGISTERS = _SCHEME.registers
_MOST = 256
_MULTIPLIERS = mix(np.arange(1, _MOST + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_GRID = np.linspace(0.4, 0.995, 60)


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's members."""
    w = split_words(texts)
    hashes = w.hashes(lower=True)
    members, first = window_hashes(w, hashes, WIDTH)
    text = w.text[first]
    order = np.lexsort((members, text))
    members, text = members[order], text[order]
    new = np.ones(len(members), bool)
    new[1:] = (members[1:] != members[:-1]) | (text[1:] != text[:-1])
    members, text = members[new], text[new]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    out = [members[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
    for i in np.flatnonzero((w.counts > 0) & (w.counts < WIDTH)):
        own = hashes[w.first[i] : w.first[i + 1]]
        total = (own * PLACES[: len(own)]).sum(keepdims=True) + PLACES[14:15] * np.uint64(len(own))
        out[i] = mix(total)
    return out


def registers(members: np.ndarray, number: int = REGISTERS) -> np.ndarray:
    """Registers of a set that isn't empty."""
    least = np.full(number, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(members), 512):
        part = members[at : at + 512] * _MULTIPLIERS[:number, None]
        np.minimum(least, part.min(axis=1), out=least)
    value = -np.log1p(-np.minimum((least.astype(np.float64) + 1) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)) + 20_000, 0, TOP).astype(np.uint16)


def band_hashes(sketches: np.ndarray, own: Scheme = _SCHEME) -> np.ndarray:
    """A hash of each band, a row per sketch."""
    parts = sketches.reshape(len(sketches), own.bands, own.rows).astype(np.uint64)
    total = np.zeros(parts.shape[:2], np.uint64)
    for k in range(own.rows):
        total += (parts[:, :, k] + np.uint64(1)) * PLACES[k]
    return mix(total + np.arange(own.bands, dtype=np.uint64) * PLACES[10]).view(np.int64)


def likeliest(greater: np.ndarray, equal: np.ndarray, smaller: np.ndarray, n: int, others: np.ndarray) -> np.ndarray:
    """Overlap of the greatest joint likelihood, for a set of ``n`` members against others of known sizes.

    Overlaps below those of interest aren't tried: the least one stands for them.
    """
    u = (n / (n + others))[:, None]
    v = 1 - u
    overlap = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))

    def chance(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    more = np.clip(chance(np.clip(u - v * overlap, 0, 1)), 1e-12, 1)
    less = np.clip(chance(np.clip(v - u * overlap, 0, 1)), 1e-12, 1)
    same = np.clip(1 - more - less, 1e-12, 1)
    like = greater[:, None] * np.log(more) + smaller[:, None] * np.log(less) + equal[:, None] * np.log(same)
    return overlap[np.arange(len(others)), like.argmax(axis=1)]


def sketch_documents(documents: DataFrame, own: Scheme = _SCHEME) -> DataFrame:
    """``doc_id, n_shingles, key_a, key_b, registers``; equal sets have equal keys; an empty set has no registers."""

    def rows(batches):
        for batch in batches:
            for first, texts in steps(batch):
                found = sets(texts)
                n = np.array([len(s) for s in found], np.int64)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(first, len(texts)).cast(pa.int64()), pa.array(n),
                     pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in found], pa.int64()),
                     pa.array([int(mix(s ^ PLACES[13]).sum(dtype=np.uint64).view(np.int64)) for s in found], pa.int64()),
                     pa.array([registers(s, own.registers).tobytes() if len(s) else None for s in found], pa.binary())],
                    ["doc_id", "n_shingles", "key_a", "key_b", "registers"],
                )

    schema = "doc_id long, n_shingles long, key_a long, key_b long, registers binary"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def _bands(classes: DataFrame, own: Scheme) -> DataFrame:
    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                sketches = np.frombuffer(b"".join(batch["registers"].to_pylist()), np.uint16)
                hashes = band_hashes(sketches.reshape(-1, own.registers), own)
                yield pa.record_batch(
                    [batch["rep"], batch["n_shingles"], pa.array(list(hashes), pa.list_(pa.int64()))],
                    ["rep", "n_shingles", "hashes"],
                )

    banded = classes.select("rep", "n_shingles", "registers").mapInArrow(
        rows, "rep long, n_shingles long, hashes array<long>"
    )
    # The band is part of the hash.
    return banded.select("rep", "n_shingles", F.explode("hashes").alias("bucket"))


def _buckets(bands: DataFrame) -> DataFrame:
    """``bucket, size, blocks`` of the buckets with several members; of those with the same members only one."""
    members = bands.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("shingles"), F.min("rep").alias("low"),
        F.max("rep").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("xor"), F.bit_xor(F.xxhash64("rep", F.lit(5))).alias("xor2"),
    )
    once = members.filter("size > 1").groupBy("size", "low", "high", "xor", "xor2").agg(
        F.min("bucket").alias("bucket"), F.max("shingles").alias("shingles")
    )
    blocks = F.greatest(F.ceil(F.col("size") / (BLOCK_ROWS / 2)), F.ceil(F.col("shingles") * 8 / (BLOCK_BYTES / 2)))
    small = (F.col("size") <= BLOCK_ROWS) & (F.col("shingles") * 8 <= BLOCK_BYTES)
    return once.select("bucket", "size", F.when(small, F.lit(1)).otherwise(blocks).cast("int").alias("blocks"))


class _Forest:
    """Disjoint sets, each named by its smallest node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, node: int) -> int:
        up = self.up
        while (above := up.get(node, node)) != node:
            up[node] = up.get(above, above)
            node = above
        return node

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def block_links(reps, components, sides, texts, sketches, both: bool, own: Scheme = _SCHEME) -> list[tuple[int, int]]:
    """Links that join the components of a block's members: (smallest member, member) for each joined set.

    With ``both`` only pairs from different sides are looked at.
    """
    members = sets(texts)
    sketch = np.array([np.frombuffer(s, np.uint16) for s in sketches])
    n = np.array([len(m) for m in members])
    forest, side = _Forest(), np.array(sides)
    component = np.array(components)
    found: list[tuple[float, int, int]] = []
    for i in range(len(reps) - 1):
        rest = np.arange(i + 1, len(reps))
        near = (np.minimum(n[rest], n[i]) * 100 >= own.percent * np.maximum(n[rest], n[i])) & (component[rest] != component[i])
        if both:
            near &= side[rest] != side[i]
        rest = rest[near]
        if not len(rest):
            continue
        equal = (sketch[rest] == sketch[i]).sum(axis=1)
        rest, equal = rest[equal >= own.least_equal], equal[equal >= own.least_equal]
        if not len(rest):
            continue
        greater = (sketch[i] > sketch[rest]).sum(axis=1)
        overlap = likeliest(greater, equal, own.registers - greater - equal, n[i], n[rest])
        found += [(-overlap[k], i, int(rest[k])) for k in np.flatnonzero(overlap >= own.look_from)]
    found.sort()
    for _, i, j in found:
        a, b = int(component[i]), int(component[j])
        if forest.root(a) == forest.root(b):
            continue
        shared = len(np.intersect1d(members[i], members[j], assume_unique=True))
        if 100 * shared >= own.percent * (n[i] + n[j] - shared):
            forest.join(a, b)
    return sorted({(forest.root(int(c)), int(c)) for c in component if forest.root(int(c)) != int(c)})


def _inside(members: DataFrame) -> DataFrame:
    """Each member in one block of its bucket: ``bucket, rep, component, side, left, right``."""
    side = F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int")
    return members.select("bucket", "rep", "component", side.alias("side"), side.alias("left"), side.alias("right"))


def _apart(members: DataFrame) -> DataFrame:
    """Members so placed that those of different components of a bucket meet.

    The largest component of a bucket of several blocks has blocks of its own, which don't meet each other, so a group of near copies
    is placed as often as the rest of its bucket has blocks, which is mostly once.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"))
    rows = members.join(largest, "bucket").withColumns({
        "large": F.when(F.col("blocks") > 1, F.ceil(F.col("blocks") * F.col("top.n") / F.col("size"))).otherwise(0).cast("int"),
        "small": F.when(F.col("blocks") > 1, F.ceil(F.col("blocks") * (1 - F.col("top.n") / F.col("size")))).otherwise(1).cast("int"),
    }).withColumn("small", F.greatest("small", F.lit(1)))
    own = (F.col("blocks") > 1) & (F.col("component") == F.col("top.component"))
    number = F.xxhash64("rep", F.lit(11))
    place = F.when(own, -1 - F.pmod(number, F.greatest("large", F.lit(1)))).otherwise(F.pmod(number, F.col("small"))).cast("int")
    among = F.sequence(F.lit(0), F.col("small") - 1)
    beyond = F.when(F.col("large") > 0, F.sequence(-F.col("large"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    met = F.when(own, among).otherwise(F.concat(beyond, among))
    placed = rows.withColumn("side", place).withColumn("other", F.explode(met))
    return placed.select(
        "bucket", "rep", "component", "side",
        F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"),
    )


def _links(placed: DataFrame, texts: DataFrame, own: Scheme) -> DataFrame:
    """Links ``a, b`` between components, from members placed in blocks."""
    rows = placed.join(texts, "rep").repartition("bucket", "left", "right")
    rows = rows.sortWithinPartitions("bucket", "left", "right", "rep")

    def groups(batches) -> Iterator[tuple[bool, list[dict]]]:
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                place = (row["bucket"], row["left"], row["right"])
                if place != key and held:
                    yield key[1] != key[2], held
                    held = []
                key = place
                held.append(row)
        if held:
            yield key[1] != key[2], held

    def found(batches):
        for both, group in groups(batches):
            links = block_links(
                [r["rep"] for r in group], [r["component"] for r in group], [r["side"] for r in group],
                [(r["text"] or "").encode() for r in group], [r["registers"] for r in group], both, own,
            )
            if links:
                yield pa.record_batch(
                    [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"]
                )

    return rows.mapInArrow(found, "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document; links share ``percent`` of the union or more."""
    own = scheme(percent)
    sketched = written(sketch_documents(documents, own), "sketches")
    classes = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key_a", "key_b").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")
    )
    # Bounds of the rows of each table, which are counted in its files.
    classes = written(packed(classes, sketched.count()), "classes")
    number = classes.count() * own.bands
    bands = written(packed(_bands(classes, own), number), "bands")
    buckets = written(packed(_buckets(bands), number), "buckets")
    members = written(packed(bands.select("bucket", "rep").join(buckets, "bucket"), number), "members")
    number = members.count()

    # A class may be the representative of several texts only if ids repeat; then any of them may stand for it.
    candidates = members.groupBy("rep").agg(F.max(F.struct("size", "bucket", "blocks")).alias("home"))
    sketches = classes.groupBy("rep").agg(F.first("registers").alias("registers"))
    text = documents.select(F.col("doc_id").cast("long").alias("rep"), "text")
    texts = text.join(candidates, "rep").join(sketches, "rep")
    texts = written(texts, "texts")

    stored = texts.select("rep", "text", "registers")
    home = texts.select("home.bucket", "home.size", "home.blocks", "rep")

    def stored_links(placed: DataFrame) -> DataFrame:
        return written(_links(placed, stored, own), "links")

    links = stored_links(_inside(home.withColumn("component", F.col("rep"))))
    joined, before = components(links), None

    def labelled(rows: DataFrame) -> DataFrame:
        named = rows.join(joined, F.col("rep") == F.col("node"), "left")
        return named.select("bucket", "size", "blocks", "rep", F.coalesce("component", "rep").alias("component"))

    # What the blocks of large buckets have found is joined by one member of each component, in fewer blocks each time.
    while True:
        heads = labelled(members.filter("blocks > 1")).groupBy("bucket", "size", "blocks", "component").agg(F.min("rep").alias("rep"))
        crowd = heads.groupBy("bucket").agg(F.count(F.lit(1)).alias("heads")).filter("heads > 1")
        heads = heads.join(crowd, "bucket").withColumn("blocks", F.ceil(F.col("blocks") * F.col("heads") / F.col("size")))
        heads = written(packed(heads, number if before is None else before), "heads")
        now = heads.count()
        if not now or (before is not None and now >= before):
            break
        links, before = links.union(stored_links(_inside(heads))), now
        joined = components(links)
    named = labelled(members)
    several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = named.join(several.filter("low <> high").select("bucket"), "bucket", "left_semi")
    open_ = written(packed(open_, number), "open")
    final = components(links.union(stored_links(_apart(open_))))

    component = classes.select("key_a", "key_b", "rep").join(final, F.col("rep") == F.col("node"), "left").select(
        "key_a", "key_b", F.coalesce("component", "rep").alias("component")
    )
    # A hot class is a hot key of this join; adaptive execution splits it, as nothing is grouped after it.
    linked = sketched.drop("registers").join(component, ["key_a", "key_b"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component_id = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return linked.select(
        "doc_id", "n_shingles", component_id.alias("component_id"), (F.col("doc_id").eqNullSafe(component_id)).alias("kept")
    )


def one_of_each(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all its columns: one row for each kept id, and every row without id.

    Of several rows with a kept id any one stays.
    """
    kept = near_duplicates(documents, percent).filter("kept AND doc_id IS NOT NULL")
    own = fresh(documents, "kept_id")
    kept = written(kept.groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("rows")), "kept")
    # Sorted and merged at every size: a broadcast at small sizes would hide what the shuffle of the texts takes.
    rows = documents.join(kept.select(own).hint("merge"), F.col("doc_id").cast("long") == F.col(own), "left_semi")
    if kept.filter("rows > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id"])
    return rows.unionByName(documents.filter("doc_id IS NULL")).select(*[f"`{name}`" for name in documents.columns])
