"""Near duplicates: MinHash signatures joined by a multi-index on Hamming distance.

A document's set is its distinct word shingles. Documents with the same set
form a class, numbered in a written table, whose text is that of its smallest
row: by id, then by the digest of the text. Each class gets a signature of SLOTS values of 16 bits, cut into chunks of four. Two signatures
that differ in fewer than 2 * CHUNKS slots agree in all but at most one slot of
some chunk (pigeonhole), so a key for each chunk and each slot left out - the
allowed errors, enumerated - meets every such pair. At a similarity of 0.75 a
pair differs in 20 of 80 slots on average, and in 40 or more with a probability
below one in a million.

Classes that share a key are candidates. In a key with at most SMALL classes
all pairs are. Classes with a larger key have a second level of keys among
themselves, of two slots of a chunk. A class knows how far a partner must be
that it has met on neither level: 3 slots in a chunk whose keys of two slots are
all small, 2 in one whose keys of three are, so if these come to DISTANCE there
is no such partner, with certainty, and the class is settled.
All others ("owners") go on in large keys. Each is tried against
CENTRES classes, drawn by hash, of its largest key in each of STARS parts of the
chunks - a fixed number of pairs a class, however many keys it has - and pairs
that are linked on their full sets are labelled by component. Keys are then
contracted to the components that they hold. Keys of two components or more join
these to regions; a region's classes outside its commonest component are its
query set, which meets all its classes in blocks, by signature and then by the
full sets. Links inside one component don't change it, so leaving them out loses
nothing.

Defined cases: null and empty texts have an empty set and stay alone; rows with
one id and different texts are judged each by its own text, and if they are in
one component, the smallest digest of a text stays; rows with the same id and
text stay or go together; a null id is larger than any other, and rows with a
null id are not related by it; a text of any length is read whole, a few MB at a
time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.bytetext import Words, grams, mix, slices, text_array
from quirework.llm.components import components
from quirework.llm.workspace import Workspace

CHUNKS, CHUNK = 20, 4
SLOTS = CHUNKS * CHUNK
#: Fewer differing slots than this are found with certainty.
DISTANCE = 2 * CHUNKS
#: Keys of more classes than this are large. A class with fewer than RICH chunks without a large key is an owner whatever its second level says.
SMALL, RICH = 12, 16
#: Parts of the chunks that give a class one star each, classes in the middle of a star, and parts that the others of one star are dealt in.
STARS, CENTRES, SALTS = 3, 2, 16
#: Bytes of text in a block.
BLOCK = 512 << 10
_SEEDS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text shorter than one shingle is one as a whole."""
    if not len(hashes):
        return hashes
    return np.unique(grams(hashes, size) if len(hashes) >= size else grams(hashes, len(hashes)) ^ np.uint64(len(hashes)))


def signature(shingles: np.ndarray) -> bytes:
    """The top 16 bits of the least value of each of SLOTS hash functions."""
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096]
        for i in range(0, SLOTS, 16):
            h = x[None, :] * _SEEDS[i : i + 16, None]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            np.minimum(low[i : i + 16], h.min(1), out=low[i : i + 16])
    return mix(low).astype("<u2").tobytes()


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = text_array(batch.column(3))
            for row, data, offsets in slices(text):
                words = Words(data, offsets, lower=True)
                counts, digests, signatures = [], [], []
                for i in range(len(offsets) - 1):
                    s = shingle_set(words.of(i), size)
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signatures.append(signature(s) if len(s) else None)
                n = len(counts)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, n) for i in range(3)), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["none", "id", "content", "n", "digest", "signature"])

    return run


def _keys(slots: int):
    """id, n, signature -> key, id, n, chunk for each chunk and choice of so many of its slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.array(list(combinations(range(CHUNK), slots)))
        each = CHUNKS * len(chosen)
        number = np.arange(each, dtype=np.uint64)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                if not len(part):
                    continue
                s = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
                kept = s[:, :, chosen]  # rows, chunks, choices, slots
                key = kept[..., 0]
                for i in range(1, slots):
                    key = (key << np.uint64(16)) | kept[..., i]
                key = mix(key.reshape(len(s), each) ^ (number[None, :] << np.uint64(50)))
                row = pa.array(np.repeat(np.arange(len(s)), each))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), part.column(0).take(row), part.column(1).take(row), pa.array(np.tile(np.repeat(np.arange(CHUNKS, dtype=np.int8), len(chosen)), len(s)))], names=["key", "id", "n", "chunk"])

    return run


def _distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in fewer than DISTANCE slots."""
    for batch in batches:
        if not len(batch):
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SLOTS) for i in (2, 3))
        near = np.flatnonzero((x != y).sum(1) < DISTANCE)
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(near)) for i in (0, 1)], names=["a", "b"])


def _confirm(size: int, percent: int):
    """Pairs with their texts -> the pairs linked on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                sets: list[list[np.ndarray]] = [[], []]
                for side in (0, 1):
                    for _, data, offsets in slices(text_array(part.column(2 + side))):
                        words = Words(data, offsets, lower=True)
                        sets[side] += [shingle_set(words.of(i), size) for i in range(len(offsets) - 1)]
                linked = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(bool(len(x) and len(y)) and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slots in which each signature of x (rows, SLOTS) differs from each of y."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for a, b in zip(x.T, y.T, strict=True):
        out += a[:, None] != b[None, :]
    return out


def _block_links(shingle: int, percent: int):
    """Packed blocks of classes -> pairs of components that a link joins, enough to join what the block joins.

    Only pairs whose signatures are near are compared in full, the nearest
    first, and none whose components the pairs before have joined.
    """

    def full(text: str) -> np.ndarray:
        _, data, offsets = next(slices(pa.array([text], pa.string())))
        return shingle_set(Words(data, offsets, lower=True).of(0), shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                x, y = (np.frombuffer(b"".join(c["signature"] for c in side), "<u2").reshape(-1, SLOTS) for side in (left, right))
                far = distances(x, y)
                apart = np.array([c["component"] for c in left])[:, None] != np.array([c["component"] for c in right])[None, :]
                near = np.argwhere((far < DISTANCE) & apart)
                near = near[np.argsort(far[near[:, 0], near[:, 1]], kind="stable")]
                joined: dict[int, int] = {}
                sets: dict[int, np.ndarray] = {}

                def root(c, joined=joined):
                    while joined.get(c, c) != c:
                        c = joined[c]
                    return c

                found = []
                for i, k in near.tolist():
                    a, b = left[i], right[k]
                    p, q = root(a["component"]), root(b["component"])
                    if p == q:
                        continue
                    for c in (a, b):
                        if c["id"] not in sets:
                            sets[c["id"]] = full(c["text"])
                    u, v = sets[a["id"]], sets[b["id"]]
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    if 100 * both >= percent * (len(u) + len(v) - both):
                        joined[max(p, q)] = min(p, q)
                        found.append((min(p, q), max(p, q)))
                yield pa.RecordBatch.from_arrays([pa.array([f[m] for f in found], pa.int64()) for m in (0, 1)], names=["a", "b"])

    return run


def _stars(owners: DataFrame, percent: int) -> DataFrame:
    """id, n and keys of classes in large keys -> pairs of a class and the centres of its largest key in each part of the chunks.

    A key that a third of all classes have is met in SALTS places.
    """
    largest = [F.array_max(F.filter("keys", lambda k, part=part: k["chunk"] % STARS == part))["key"] for part in range(STARS)]
    own = owners.select("id", "n", F.explode(F.array_distinct(F.array_compact(F.array(*largest)))).alias("key"))
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(seed)).alias("luck"), F.col("id").alias("c"), F.col("n").alias("m"))) for seed in range(CENTRES)]
    centres = own.groupBy("key").agg(F.array(*drawn).alias("drawn")).select("key", F.array_distinct(F.transform("drawn", lambda x: F.struct(x["c"].alias("c"), x["m"].alias("m")))).alias("centres"))
    centres = centres.select("key", "centres", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(centres, ["key", "salt"])
    # at most STARS * CENTRES rows a class
    spokes = met.select("id", "n", F.inline("centres")).where((F.col("id") != F.col("c")) & _close("n", "m", percent))
    return spokes.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))


def _close(x: str, y: str, percent: int) -> F.Column:
    """Sizes that a pair as similar as asked can have."""
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _candidates(classes: DataFrame, percent: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """id, n, signature -> pairs a < b that share a small key, and the owners: id, n, keys (members, chunk, key of each large one).

    Every pair whose signatures differ in fewer than DISTANCE slots is among
    the pairs or is one of two owners that share a large key.
    """

    def members_of(rows: DataFrame, slots: int, name: str) -> DataFrame:
        """Keys of two classes or more, a row for each class in them."""
        keyed = rows.select("id", "n", "signature").mapInArrow(_keys(slots), "key bigint, id bigint, n bigint, chunk byte")
        shared = work.save(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), f"{name}-shared")
        out = work.save(keyed.join(shared, "key"), name)
        work.drop(f"{name}-shared")
        return out

    def met(rows: DataFrame) -> DataFrame:
        """Pairs of classes in one key of which one asks."""
        left, right = rows.select("key", "id", "n", "asks"), rows.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("asks").alias("asked"))
        pairs = left.join(right, "key").where((F.col("id") < F.col("b")) & (F.col("asks") | F.col("asked")) & _close("n", "m", percent))
        return pairs.select(F.col("id").alias("a"), "b").distinct()

    members = members_of(classes, 3, "members")
    # at most SLOTS keys a class
    large = members.where(F.col("members") > SMALL).groupBy("id", "n").agg(F.collect_list(F.struct("members", "chunk", "key")).alias("keys"))
    large = work.save(large, "large")

    # a partner that shares no small key shares a large one, so both are in this table
    second = members_of(large.select("id", "n").join(classes.select("id", "signature"), "id"), 2, "members-2")
    crowded = second.where(F.col("members") > SMALL).groupBy("id").agg(F.count_distinct("chunk").alias("crowded"))
    # a large key's classes are all here, so its chunk is crowded too
    held = F.size(F.array_distinct(F.col("keys.chunk")))
    crowd = F.coalesce("crowded", F.lit(0))
    settled = (3 * (CHUNKS - crowd) + 2 * (crowd - held) >= DISTANCE) & (held <= CHUNKS - RICH)
    judged = work.save(large.join(crowded, "id", "left").select("id", "n", "keys", settled.alias("settled")), "judged")
    work.drop("large")

    once = met(members.where(F.col("members") <= SMALL).withColumn("asks", F.lit(True)))
    twice = met(second.where(F.col("members") <= SMALL).join(judged.select("id", F.col("settled").alias("asks")), "id"))
    return once.union(twice), judged.where("NOT settled").drop("settled")


def _in_blocks(owners: DataFrame, labels: DataFrame, texts: DataFrame, work: Workspace, shingle: int, percent: int) -> DataFrame | None:
    """Pairs of components that links between owners join, where these share a large key; None if no key holds two.

    Components that share keys, directly or not, make a region. Its query set,
    the classes outside its commonest component, meets all its classes in
    blocks of about BLOCK bytes of text; a block pair is compared inside one
    task, which gives links only.
    """
    placed = owners.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = work.save(placed.select("id", "component", F.col("keys.key").alias("keys")), "placed")
    held = work.save(placed.select("component", F.explode("keys").alias("key")).distinct(), "held")
    open_ = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "lo")
    bridges = work.save(held.join(open_, "key").where("component <> lo").select(F.col("component").alias("a"), F.col("lo").alias("b")).distinct(), "bridges")
    if not bridges.limit(1).count():
        return None
    region = components(bridges, work, "regions").select(F.col("node").alias("component"), F.col("component").alias("region"))
    members = placed.select("id", "component").join(region, "component").join(texts, "id")
    members = work.save(members, "members-of-regions")
    counts = members.groupBy("region", "component").agg(F.count("*").alias("n"), F.sum(F.length("text") + 2 * SLOTS).alias("bytes"))
    sizes = counts.groupBy("region").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("bytes").alias("bytes"))
    sizes = work.save(sizes.select("region", "main", F.ceil(F.col("bytes") / BLOCK).alias("blocks")), "sizes")
    members = members.join(sizes, "region").withColumn("query", F.col("component") != F.col("main")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    packed = members.groupBy("region", "query", "block").agg(F.collect_list(F.struct("id", "component", "signature", "text")).alias("classes"))
    packed = work.save(packed, "packed")
    left = packed.where("query").select("region", "block", F.col("classes").alias("left"))
    right = packed.select("region", "query", F.col("block").alias("other"), F.col("classes").alias("right"))
    pairs = left.select("region", "block").join(right.select("region", "query", "other"), "region").where("NOT query OR other >= block")
    pairs = work.save(pairs, "block-pairs").join(left, ["region", "block"]).join(right, ["region", "query", "other"])
    links = work.save(pairs.select("left", "right").mapInArrow(_block_links(shingle, percent), "a bigint, b bigint"), "links-2")
    work.drop("placed", "held", "bridges", "members-of-regions", "sizes", "packed", "block-pairs")
    return links


def _content(text) -> F.Column:
    """Digest of a text: with the id it names a row."""
    return F.unhex(F.md5(text))


def _row(id_: F.Column, text: F.Column) -> list[F.Column]:
    """none (is the id null), id (0 if it is), content: what tells rows apart, in the order of rows."""
    id_ = id_.cast("bigint")
    return [id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), F.coalesce(_content(text), F.lit(b"")).alias("content")]


_ROW = ["none", "id", "content"]


def _judged(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, work: Workspace | None) -> DataFrame:
    """One row a document: none, id, content, n, least (none, id and content of its component's smallest row), kept."""
    if percent < 75:
        raise ValueError("the keys are laid out for similarities of 75 percent and more")
    work = work or Workspace(docs.sparkSession)
    rows = docs.select(*_row(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    sketches = work.save(rows.mapInArrow(_sketch(shingle), "none boolean, id bigint, content binary, n bigint, digest binary, signature binary"), "sketches")

    classes = sketches.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(*_ROW)).alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = work.save(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    def near(pairs: DataFrame, name: str) -> DataFrame:
        """Candidate pairs a < b whose signatures are near."""
        sig = classes.select(F.col("cls").alias("id"), "signature")
        pairs = pairs.distinct()
        pairs = pairs.join(sig.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
        return work.save(pairs.select("a", "b", "sa", "sb").mapInArrow(_distance, "a bigint, b bigint").distinct(), name)

    pairs, owners = _candidates(classes.select(F.col("cls").alias("id"), "n", "signature"), percent, work)
    first = near(pairs.union(_stars(owners, percent)), "near-1")
    work.drop("members", "members-2")

    wanted = first.select(F.col("a").alias("id")).union(first.select("b")).union(owners.select("id")).distinct()
    # the same plan at every size: one shuffle of the texts
    named = classes.select(F.col("cls").alias("id"), "least", "signature").join(wanted, "id").select(F.col("id").alias("cls"), "signature", "least.none", "least.id", "least.content")
    texts = work.save(rows.join(named.hint("merge"), _ROW).dropDuplicates(_ROW).select(F.col("cls").alias("id"), "text", "signature"), "texts")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return work.save(full.select("a", "b", "ta", "tb").mapInArrow(_confirm(shingle, percent), "a bigint, b bigint"), name)

    links = confirmed(first, "links-1")
    labels = components(links, work, "labels-1")
    more = _in_blocks(owners, labels, texts, work, shingle, percent)
    if more is not None and more.limit(1).count():
        # by component: the links inside one are done with
        wider = components(more, work, "labels-2").withColumnRenamed("component", "wider")
        labels = labels.union(wider.select("node", F.col("node").alias("component"))).distinct()
        labels = labels.join(wider.select(F.col("node").alias("component"), "wider"), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    work.drop("judged", "texts", "near-1")

    joined = labels.join(classes.select(F.col("cls").alias("node"), "least"), "node")
    joined = joined.select("node", "component").join(joined.groupBy("component").agg(F.min("least").alias("first")), "component")
    names = classes.select("digest", "least", F.col("cls").alias("node")).join(joined, "node", "left").select("digest", F.coalesce("first", "least").alias("least"))
    out = sketches.drop("signature").join(names, "digest", "left").withColumn("least", F.coalesce("least", F.struct(*_ROW)))
    same = (F.col("none") == F.col("least.none")) & (F.col("id") == F.col("least.id")) & (F.col("content") == F.col("least.content"))
    return out.select(*_ROW, "n", "least", (F.col("digest").isNull() | same).alias("kept"))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, work: Workspace | None = None) -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept. Linked: 100 * intersection >= percent * union.

    component_id is the smallest id of the component: null if it has null ids only.
    percent: 75 or more; lower similarities differ in more slots than the keys allow for.
    """
    out = _judged(docs, id_col, text_col, shingle, percent, work)
    return out.select(F.when(~F.col("none"), F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), F.when(~F.col("least.none"), F.col("least.id")).alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """The rows of docs that are the smallest of their group, by id and then by digest of the text."""
    dropped = _judged(docs, id_col, text_col, 5, 75, work).where(~F.col("kept")).select(*[F.col(c).alias(f"__drop_{c}") for c in _ROW]).distinct()
    row = _row(docs[id_col], docs[text_col])
    return docs.join(dropped, (row[0] == F.col("__drop_none")) & (row[1] == F.col("__drop_id")) & (row[2] == F.col("__drop_content")), "left_anti")
