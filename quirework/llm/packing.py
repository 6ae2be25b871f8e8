"""Packing token sequences into fixed windows by non-negative least squares.

Each document is cut into whole windows and one tail. The histogram of tail
lengths (at most ``window`` numbers) goes to the driver, where combinations of
up to three lengths that fill a window exactly are enumerated and their repeat
counts are fitted to the histogram by non-negative least squares: coordinates
that break the optimality conditions are moved, the worst first, until none
breaks them by more than TOLERANCE of the largest count. Counts are rounded;
tails that no combination takes form one residual stream, packed greedily, the
longest first, and cut where a window is full. The fit is what saves cuts: the
stream alone would cut a document at nearly every window's end.

Where a piece goes follows from its rank among the pieces of its length. Ranks
come from counts by (partition, length), so no task holds all pieces of a
length, however common it is. Those counts grow with the partitions of the
input, so Spark broadcasts them only below its threshold and shuffles by
(length, partition) beyond.

Defined cases: a null or empty text is its end token alone; a text of any length
is encoded whole and cut into windows; repeated rows are packed one by one; an
empty table gives no rows; columns other than the two named are ignored. Window
sizes up to 4096 are accepted; ids that don't fit the bytes asked for are an
error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.bytetext import text_array
from quirework.llm.encoding import encoder
from quirework.llm.workspace import Workspace


#: Largest breach of the optimality conditions, as a share of the largest count; coordinates moved in one round; most rounds.
TOLERANCE, MOVED, ROUNDS = 1e-4, 2000, 3000


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Every way to fill the window with two or three of the lengths present, as rows of three lengths (0: none); pairs first."""
    a = np.arange(1, window // 2 + 1)[::-1]
    pairs = np.stack((a, window - a, np.zeros_like(a)), 1)
    out = [pairs[present[a] & present[window - a]]]
    for a in range(1, window // 3 + 1):
        if present[a]:
            b = np.arange(a, (window - a) // 2 + 1)
            c = window - a - b
            fits = present[b] & present[c]
            out.append(np.stack((np.full(fits.sum(), a), b[fits], c[fits]), 1))
    return np.concatenate(out)


def fit(hist: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts x >= 0 that minimise ||A x - hist||, hist - A x), column j of A having a one for each length of found[j]."""
    left = hist.astype(float)
    left[0] = 0
    counts = np.zeros(len(found))
    same = [(found[:, i] == found[:, j]) & (found[:, i] > 0) for i in range(3) for j in range(3)]
    norms = np.sum(same, 0)
    tolerance = max(0.5, TOLERANCE * hist.max(initial=0))
    order = np.flatnonzero(found[:, 2] == 0)  # two-piece combinations come first, so few columns get weight
    for _ in range(ROUNDS):
        for j in order.tolist():
            a, b, c = found[j].tolist()
            step = max((left[a] + left[b] + left[c]) / norms[j], -counts[j])
            counts[j] += step
            for x in (a, b, c):
                left[x] -= step
            left[0] = 0
        worst = breach(counts, left, found)
        order = np.argsort(-worst, kind="stable")[:MOVED]
        order = order[worst[order] > tolerance]
        if not len(order):
            break
    return counts, left


def breach(counts: np.ndarray, left: np.ndarray, found: np.ndarray) -> np.ndarray:
    """How far each coordinate is from the optimality conditions: no gradient where it is positive, none upwards where it is 0."""
    gradient = left[found].sum(1)
    return np.where(counts > 0, np.abs(gradient), np.maximum(gradient, 0))


def solve(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with whole repeat counts that the histogram can pay for."""
    found = combinations(window, hist > 0)
    counts, _ = fit(hist, found)
    found = [tuple(x for x in row if x) for row in found.tolist()]
    have, out = hist.copy(), []
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] < 0.5:
            break
        lengths = found[j]
        take = min(int(round(counts[j])), *(int(have[a]) // lengths.count(a) for a in lengths))
        if take > 0:
            for a in lengths:
                have[a] -= take
            out.append((lengths, take))
    return out


def _pieces(vocabulary: str, window: int, end_id: int, kind: str):
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seen, row = encoder(vocabulary, kind), TaskContext.get().partitionId(), {}, 0
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            ids = batch.column(0)
            texts = text_array(batch.column(1))
            for at in range(0, len(texts), 256):
                got = {k: [] for k in ("key", "row", "start", "ids", "length", "total", "idx")}
                for i, x in enumerate(code.encode(texts[at : at + 256].to_pylist())):
                    x += end
                    total = len(x) // size
                    for start in range(0, total, window):
                        n = min(window, total - start)
                        got["key"].append(at + i)
                        got["row"].append((part << 33) + row)
                        got["start"].append(start)
                        got["ids"].append(x[start * size : (start + n) * size])
                        got["length"].append(n)
                        got["total"].append(total)
                        got["idx"].append(seen.get(n, 0))
                        seen[n] = seen.get(n, 0) + 1
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(got["key"], pa.int64())), pa.array(got["row"], pa.int64()), pa.array(got["start"], pa.int64()), pa.array(got["ids"], pa.binary()), pa.array(got["length"], pa.int32()), pa.array(got["total"], pa.int64()), pa.array([part] * len(got["key"]), pa.int32()), pa.array(got["idx"], pa.int64())],
                    names=["doc", "doc_row", "start", "ids", "length", "doc_tokens", "part", "idx"],
                )

    return run


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, id_bytes: int = 2, work: Workspace | None = None) -> DataFrame:
    """Pieces with their place: doc_id, doc_row, start, length, ids (little-endian
    unsigned integers of id_bytes each), doc_tokens, sequence_id, offset.

    doc_row tells repeated rows apart. A sequence is padded to the window by
    whoever writes it; only the last one can have room left.
    """
    work = work or Workspace(docs.sparkSession)
    kind = f"<u{id_bytes}"
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {id_type}, doc_row bigint, start bigint, ids binary, length int, doc_tokens bigint, part int, idx bigint"
    pieces = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_pieces(vocabulary, window, end_id, kind), schema)
    pieces = work.save(pieces, "pieces")

    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = work.save(counts, "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        hist[r["length"]] = r["n"]
    packed = sequences(hist, window)
    places = _places(hist, window, packed)

    table = docs.sparkSession.createDataFrame(places, "length int, taken bigint, stream bigint, slots array<struct<first: bigint, sequence: bigint, offset: int>>")
    rank = F.col("base") + F.col("idx")
    # one row for each length; rows for each (length, partition) grow with the partitions, so Spark chooses how to join them
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", rank).join(F.broadcast(table), "length")
    slot = F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1)
    at = F.col("stream") + (F.col("rank") - F.col("taken")) * F.col("length")
    first_stream = sum(n for _, n in packed)
    ranked = ranked.withColumn("slot", F.when(F.col("rank") < F.col("taken"), slot)).withColumn("at", at)
    sequence = F.when(F.col("slot").isNotNull(), F.col("slot.sequence") + F.col("rank") - F.col("slot.first")).otherwise(F.lit(first_stream) + F.expr(f"at div {window}"))
    offset = F.when(F.col("slot").isNotNull(), F.col("slot.offset")).otherwise(F.expr(f"int(at % {window})"))
    ranked = ranked.select("doc", "doc_row", "start", "ids", "length", "doc_tokens", sequence.alias("sequence_id"), offset.alias("offset"))
    room = F.lit(window) - F.col("offset")

    def piece(skip, n, sequence, offset):
        return F.struct((F.col("start") + skip).alias("start"), n.cast("bigint").alias("length"), F.expr("ids").substr(skip * id_bytes + 1, n * id_bytes).alias("ids"), sequence.alias("sequence_id"), offset.cast("bigint").alias("offset"))

    whole = piece(F.lit(0), F.col("length"), F.col("sequence_id"), F.col("offset"))
    rest = piece(room, F.col("length") - room, F.col("sequence_id") + 1, F.lit(0))
    cut = F.when(F.col("length") > room, F.array(piece(F.lit(0), room, F.col("sequence_id"), F.col("offset")), rest)).otherwise(F.array(whole))
    return ranked.select(F.col("doc").alias(id_col), "doc_row", "doc_tokens", F.inline(cut))


def sequences(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """The combinations with the whole window in front."""
    tails = hist.copy()
    tails[window] = 0
    whole = [((window,), int(hist[window]))] if hist[window] else []
    return whole + solve(tails, window)


def cuts(hist: np.ndarray, window: int, packed: list[tuple[tuple[int, ...], int]]) -> int:
    """Pieces that the residual stream cuts in two."""
    cut = 0
    for length, used, stream, _ in _places(hist, window, packed):
        rest = int(hist[length]) - used
        ends = np.arange(1, rest + 1, dtype=np.int64) * length + stream
        cut += int((((ends - 1) // window) > ((ends - length) // window)).sum())
    return cut


def _places(hist: np.ndarray, window: int, packed: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """For each length: ranks below `taken` go to slots, the rest to the residual stream from `stream` on."""
    used, slots, sequence = np.zeros(window + 1, np.int64), {}, 0
    for lengths, n in packed:
        offset = 0
        for a in lengths:
            slots.setdefault(a, []).append((int(used[a]), sequence, offset))
            used[a] += n
            offset += a
        sequence += n
    out, stream = [], 0
    for a in range(window, 0, -1):
        if hist[a]:
            out.append((a, int(used[a]), stream, slots.get(a, [])))
            stream += int(hist[a] - used[a]) * a
    return out


def with_crc32(pieces: DataFrame, id_bytes: int = 2) -> DataFrame:
    """Adds ids_crc32: of the ids as little-endian unsigned 32-bit integers. Other columns stay, ids go."""
    import zlib

    fields = [f for f in pieces.schema.fields if f.name != "ids"]

    def run(batches):
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x, f"<u{id_bytes}").astype("<u4").tobytes()) for x in (v.as_buffer() for v in batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(crc, pa.int64())], names=[*(f.name for f in fields), "ids_crc32"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids_crc32 bigint"
    return pieces.mapInArrow(run, schema)
