"""Repeated passages through a compacted de Bruijn graph.

Nodes are token k-mers that are least by hash among the k-mers of some window,
so every window holds one whole; edges join the nodes that follow each other in
a document and stand for the exact words between. A node or edge of one
document only can't lie in a repeated window and goes at once. Edges that are
the only way out of one node and into the next are joined: each edge points to
the next, and pointers are doubled by Spark joins until every path has one
name. A document that holds one edge of such a path holds all of it, so one
row a path decides the windows inside it.

What is left are windows at the ends of paths. They meet by hash. Every window
that goes has the coordinates of the same words in a document of a smaller id:
consecutive ones make a span with its source, the words of the source are read
back from there, and a span goes only if the digests of its words and of the
source's agree. So hashes only propose; a span whose words differ from its
source's would stay.

Documents with the same words form a class beforehand; the smallest id stands
for it in the graph. Defined cases: null texts have no words; rows with one id
and the same words are one document, with different words each for itself (told
apart by 24 bits of a digest) and never remove each other's words; a null id is
larger than any other; a text of any length is hashed a few MB at a time, and its
words are a list in one task where it holds repeated nodes; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.bytetext import Words, grams, slices, stretches, text_array
from quirework.llm.workspace import Workspace

#: Null ids sort with the largest id; the flag beside it, the top bit of a place, comes after.
_LAST = (1 << 63) - 1
_TIE = 1 << 24
_NONE = 1 << 62
KMER = 10


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    size, m = 1, h
    while 2 * size <= n:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (n - size)], m[n - size :]) if size < n else m


def _most(h: np.ndarray, n: int) -> np.ndarray:
    return ~_least(~h, n)


def anchors(hashes: np.ndarray, window: int, kmer: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-mers that are least in some window."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = grams(hashes, kmer)
    span = window - kmer + 1
    low = _least(h, span)
    padded = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
    at = np.flatnonzero(_most(padded, span) == h)
    return at, h[at]


def _segments(hashes: np.ndarray, at: np.ndarray, kmer: int) -> np.ndarray:
    """A hash of the words from each anchor to the end of the next; the last has none (0)."""
    out = np.zeros(len(at), np.uint64)
    if len(at) > 1:
        out[:-1] = np.maximum(stretches(hashes, at[:-1], at[1:] + kmer), np.uint64(1))
    return out


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(b" ".join(text.split())).digest()


def _tie(sha: bytes) -> int:
    return int.from_bytes(sha[:3], "little")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan(window: int, kmer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = text_array(batch.column(2))
            for row, data, offsets in slices(text):
                words = Words(data, offsets)
                n = len(offsets) - 1
                shas, nodes, segments, places, ends = [], [], [], [], [0]
                raw = data.tobytes()
                for i in range(n):
                    shas.append(_digest(raw[offsets[i] : offsets[i + 1]]))
                    own = words.of(i)
                    at, h = anchors(own, window, kmer)
                    nodes.append(h)
                    segments.append(_segments(own, at, kmer))
                    places.append(at)
                    ends.append(ends[-1] + len(at))
                lists = pa.array(ends, pa.int32())
                struct = pa.StructArray.from_arrays([_signed(np.concatenate(nodes)), _signed(np.concatenate(segments)), pa.array(np.concatenate(places).astype(np.int32))], names=["node", "seg", "pos"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(words.rows).astype(np.int64)), pa.array(shas, pa.binary()), pa.ListArray.from_arrays(lists, struct)], names=["id", "none", "n_words", "sha", "anchors"])

    return run


class Span(NamedTuple):
    """Words [at, at + length) of a document, and the document and place of a smaller id where they stand too."""

    at: int
    length: int
    id: int
    place: int


def _place(pos: int, none: int, tie: int) -> int:
    """Position, null flag and tie as one number, in the order of (flag, position)."""
    return none * _NONE + pos * _TIE + tie


def _walks(path: dict, window: int, kmer: int) -> Iterator[tuple[int, int, int]]:
    """(first node, last node, stop) of each stretch that follows one path: windows [its first position, stop) lie in it whole."""
    pos, name = path["pos"], path["path"]
    run = 0
    while run < len(pos):
        if name[run] is None:
            run += 1
            continue
        end = run
        while end < len(pos) - 1 and name[end] == name[run] and path["joined"][end]:
            end += 1
            if path["last"][end - 1]:  # a path that is walked again is a walk of its own
                break
        # edges run .. end-1 of one path, nodes run .. end
        stop = pos[end] + kmer - window + 1
        if end > run and stop > pos[run]:
            yield run, end, stop
        run = max(end, run + 1)


def _earlier(source: dict, who: tuple[int, int]) -> bool:
    return (source["id"], source["place"] // _NONE) < who


def _decided(count: int, path: dict, who: tuple[int, int], window: int, kmer: int, least_at: np.ndarray) -> np.ndarray:
    """Whether the paths of a document decide each window start. who: id and null flag; least_at: position of the least k-mer of each window."""
    decided = np.zeros(count, bool)
    pos = path["pos"]
    for run, end, stop in _walks(path, window, kmer):
        whole = slice(pos[run], stop)
        if _earlier(path["least"][run], who):
            decided[whole] = True
        else:  # who has an inner node of the path has the path, and decides the window by it
            decided[whole] |= (least_at[whole] > pos[run]) & (least_at[whole] < pos[end])
    return decided


def _spans(path: dict, starts: list[dict], who: tuple[int, int], window: int, kmer: int) -> list[Span]:
    """What a document may lose: its stretches along paths of an earlier document, and runs of windows that follow one source."""
    out = []
    for run, _, stop in _walks(path, window, kmer):
        source = path["least"][run]
        if _earlier(source, who):
            out.append(Span(path["pos"][run], stop - 1 + window - path["pos"][run], source["id"], source["place"]))
    first = None
    for x in sorted(starts, key=lambda x: x["pos"]):
        if first is not None and (x["pos"] - first["pos"], x["id"], x["place"] - first["place"]) == (n, first["id"], n * _TIE):
            n += 1
            continue
        if first is not None:
            out.append(Span(first["pos"], n - 1 + window, first["id"], first["place"]))
        first, n = x, 1
    if first is not None:
        out.append(Span(first["pos"], n - 1 + window, first["id"], first["place"]))
    return out


def _each(batch: pa.RecordBatch, text_column: int):
    """(row, bytes, word hashes) of each row of a batch."""
    for row, data, offsets in slices(text_array(batch.column(text_column))):
        words = Words(data, offsets)
        raw = data.tobytes()
        for i in range(len(offsets) - 1):
            yield row + i, raw[offsets[i] : offsets[i + 1]], words.of(i)


def _least_positions(hashes: np.ndarray, window: int, kmer: int) -> np.ndarray:
    h = grams(hashes, kmer)
    span = window - kmer + 1
    out = np.empty(len(hashes) - window + 1, np.int64)
    for at in range(0, len(out), 1 << 16):
        part = h[at : at + (1 << 16) + span - 1]
        out[at : at + (1 << 16)] = sliding_window_view(part, span).argmin(1)[: len(out) - at] + at + np.arange(min(1 << 16, len(out) - at))
    return out


def _paths_of(value: list[dict]) -> dict:
    value = sorted(value, key=lambda x: x["pos"])
    return {k: [x[k] for x in value] for k in ("pos", "path", "least", "joined", "last")}


def _windows(window: int, kmer: int):
    """id, none, tie, text, hits -> hash, id, place of the windows that paths don't decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nones, ties, hits = (batch.column(i) for i in (0, 1, 2, 4))
            for row, raw, hashes in _each(batch, 3):
                tie, none, d = ties[row].as_py(), nones[row].as_py(), ids[row].as_py()
                if len(hashes) < window or _tie(_digest(raw)) != tie:
                    continue
                path = _paths_of(hits[row].as_py())
                least_at = _least_positions(hashes, window, kmer)
                decided = _decided(len(least_at), path, (d, none), window, kmer, least_at)
                own = np.flatnonzero(np.isin(least_at, np.array(path["pos"])) & ~decided)
                if len(own):
                    yield pa.RecordBatch.from_arrays([_signed(grams(hashes, window)[own]), pa.array(np.full(len(own), d)), pa.array(_place(own, none, tie))], names=["hash", "id", "place"])

    return run


def _proposed(window: int, kmer: int):
    """id, none, tie, hits, starts -> id, none, tie, at, length, s_id, s_place of each span that may go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = [], []
            ids, nones, hits, starts = (batch.column(i) for i in (0, 1, 3, 4))
            for row in range(len(batch)):  # one at a time: as Python objects a batch's hits would be many times their size
                found = _spans(_paths_of(hits[row].as_py()), starts[row].as_py() or [], (ids[row].as_py(), nones[row].as_py()), window, kmer)
                rows += [row] * len(found)
                spans += found
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)), *(pa.array([x[i] for x in spans], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64())))], names=["id", "none", "tie", "at", "length", "s_id", "s_place"])

    return run


def _span_digest(words: list[bytes], at: int, length: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[at : at + length]), digest_size=16).digest()


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, none, tie, text, asked (place and length of spans) -> s_id, s_place, length, digest of the words there."""
    for batch in batches:
        ids, ties, texts, asked = batch.column(0), batch.column(2), batch.column(3), batch.column(4)
        got = []
        for row in range(len(batch)):
            raw = (texts[row].as_py() or "").encode()
            if _tie(_digest(raw)) == ties[row].as_py():
                words, d = raw.split(), ids[row].as_py()
                got += [(d, x["place"], x["length"], _span_digest(words, x["place"] % _NONE // _TIE, x["length"])) for x in asked[row].as_py()]
        yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["s_id", "s_place", "length", "digest"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, none, tie, text, spans (at, length, digest of the source's words) -> id, none, tie, n_removed, digest of the kept words, removed spans."""
    for batch in batches:
        ties, texts, spans = batch.column(2), batch.column(3), batch.column(4)
        got = {k: [] for k in ("row", "n", "sha", "spans")}
        for row in range(len(batch)):
            raw = (texts[row].as_py() or "").encode()
            if _tie(_digest(raw)) != ties[row].as_py():
                continue
            words = raw.split()
            cover = np.zeros(len(words) + 1, np.int64)
            for x in spans[row].as_py():
                if _span_digest(words, x["at"], x["length"]) == x["digest"]:
                    cover[x["at"]] += 1
                    cover[x["at"] + x["length"]] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            got["row"].append(row)
            got["n"].append(int(gone.sum()))
            got["sha"].append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
            got["spans"].append(edge.reshape(-1, 2).tolist())
        take = pa.array(got["row"], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)), pa.array(got["n"], pa.int64()), pa.array(got["sha"], pa.string()), pa.array(got["spans"], pa.list_(pa.list_(pa.int32())))], names=["id", "none", "tie", "n_removed", "kept_sha256", "spans"])


def _named_paths(edges: DataFrame, work: Workspace) -> DataFrame:
    """seg, path: the last edge of the nonbranching path that an edge lies on."""
    into = edges.where("uses = v_uses").select("seg", F.col("v").alias("via"))
    out = edges.where("uses = u_uses").select(F.col("seg").alias("next"), F.col("u").alias("via"))
    step = into.join(out, "via").where("seg <> next").select("seg", "next")
    step = work.save(step, "step-0")
    for k in range(1, 40):
        onward = step.select(F.col("seg").alias("next"), F.col("next").alias("further"))
        moved = work.save(step.join(onward, "next", "left").select("seg", F.coalesce("further", "next").alias("next"), F.col("further").isNotNull().alias("moved")), f"step-{k}")
        work.drop(f"step-{k - 1}")
        step = moved.select("seg", "next")
        if not moved.where("moved").limit(1).count():
            break
    return edges.select("seg", "least").join(step, "seg", "left").select("seg", F.coalesce("next", "seg").alias("path"), "least")


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, kmer: int = KMER, work: Workspace | None = None) -> DataFrame:
    """One row a document: id, n_words, n_removed, kept_sha256 (kept words joined by a space), spans ([first, end) of removed words)."""
    if not 2 <= kmer <= 16 or window < kmer:
        raise ValueError("kmer is 2 to 16 and at most the window")
    work = work or Workspace(docs.sparkSession)
    id_ = F.col(id_col).cast("bigint")
    rows = docs.select(F.coalesce(id_, F.lit(_LAST)).alias("id"), id_.isNull().cast("int").alias("none"), F.col(text_col).alias("text"))
    scan = work.save(rows.mapInArrow(_scan(window, kmer), "id bigint, none int, n_words bigint, sha binary, anchors array<struct<node: bigint, seg: bigint, pos: int>>"), "scan")

    tie = F.conv(F.hex(F.concat(F.substring("sha", 3, 1), F.substring("sha", 2, 1), F.substring("sha", 1, 1))), 16, 10).cast("int")
    place = F.col("none") * F.lit(_NONE) + F.col("pos").cast("bigint") * F.lit(_TIE) + F.col("tie")
    none_of = lambda c: F.expr(f"{c} div {_NONE}")
    classes = scan.where(F.col("n_words") >= window).groupBy("sha").agg(F.min(F.struct("id", "none")).alias("first"), F.first("anchors").alias("anchors"))
    classes = classes.select("first.id", "first.none", tie.alias("tie"), "anchors")
    seen = work.save(classes.select("id", "none", "tie", F.inline("anchors")), "seen")
    several = (F.min("id") < F.max("id")) | (F.min("none") < F.max("none"))
    nodes = work.save(seen.groupBy("node").agg(F.count("*").alias("uses"), several.alias("several")).where("several").select("node", "uses"), "nodes")
    hits = seen.join(nodes, "node").groupBy("id", "none", "tie").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "seg", "uses"))).alias("hits"))
    hits = work.save(hits, "hits")
    work.drop("seen")

    follow = F.transform("hits", lambda x, i: F.struct(x["pos"].alias("pos"), x["node"].alias("u"), x["uses"].alias("u_uses"), x["seg"].alias("seg"), F.get("hits", i + 1)["node"].alias("v"), F.get("hits", i + 1)["uses"].alias("v_uses"), F.get("hits", i + 1)["pos"].alias("v_pos")))
    pairs = hits.select("id", "none", "tie", F.inline(follow)).withColumn("joined", (F.col("v_pos") - F.col("pos") <= window - kmer + 1) & (F.col("seg") != 0))
    # a neighbour among the hits that isn't the next node has another edge between; its segment hash then meets no other use
    edges = pairs.where("joined").groupBy("seg").agg(F.min("u").alias("u"), F.min("v").alias("v"), F.min("u_uses").alias("u_uses"), F.min("v_uses").alias("v_uses"), F.count("*").alias("uses"), F.min(F.struct("id", place.alias("place"))).alias("least"), several.alias("several")).where("several")
    edges = work.save(edges, "edges")
    named = work.save(_named_paths(edges, work), "named")
    placed = pairs.join(named, "seg", "left").groupBy("id", "none", "tie").agg(F.collect_list(F.struct("pos", "path", "least", "joined", (F.col("seg") == F.col("path")).alias("last"))).alias("hits"))
    placed = work.save(placed, "placed")
    work.drop("hits", "edges", "named", "nodes")

    who = ["id", "none"]
    left = rows.join(placed, who).select("id", "none", "tie", "text", "hits")
    windows = work.save(left.mapInArrow(_windows(window, kmer), "hash bigint, id bigint, place bigint"), "windows")
    source = windows.withColumn("none", none_of("place")).groupBy("hash").agg(F.min(F.struct("id", "place")).alias("source"), several.alias("several")).where("several").select("hash", "source")
    source = work.save(source, "sources")  # a table, so that a join with very common windows can be split
    after = (F.col("source.id") < F.col("id")) | ((F.col("source.id") == F.col("id")) & (none_of("source.place") < none_of("place")))
    later = windows.join(source, "hash").where(after)
    start = F.struct(F.expr(f"int(place % {_NONE} div {_TIE})").alias("pos"), F.col("source.id").alias("id"), F.col("source.place").alias("place"))
    starts = later.groupBy("id", none_of("place").cast("int").alias("none"), F.expr(f"int(place % {_TIE})").alias("tie")).agg(F.collect_list(start).alias("starts"))
    todo = placed.join(starts, ["id", "none", "tie"], "left").select("id", "none", "tie", "hits", "starts")
    spans = work.save(todo.mapInArrow(_proposed(window, kmer), "id bigint, none int, tie int, at int, length int, s_id bigint, s_place bigint"), "proposed")
    work.drop("windows", "sources", "placed")

    asked = spans.select(F.col("s_id").alias("id"), none_of("s_place").cast("int").alias("none"), F.expr(f"int(s_place % {_TIE})").alias("tie"), F.col("s_place").alias("place"), "length").distinct()
    asked = asked.groupBy("id", "none", "tie").agg(F.collect_list(F.struct("place", "length")).alias("asked"))
    words = rows.join(asked, who).select("id", "none", "tie", "text", "asked").mapInArrow(_read_back, "s_id bigint, s_place bigint, length int, digest binary")
    words = work.save(words.dropDuplicates(["s_id", "s_place", "length"]), "read-back")
    found = spans.join(words, ["s_id", "s_place", "length"]).groupBy("id", "none", "tie").agg(F.collect_list(F.struct("at", "length", "digest")).alias("spans"))
    # the rows of a class other than the smallest lose every word; only the smallest comes here
    done = rows.join(found, who).select("id", "none", "tie", "text", "spans").mapInArrow(_finish, "id bigint, none int, tie int, n_removed bigint, kept_sha256 string, spans array<array<int>>")
    done = work.save(done.dropDuplicates(["id", "none", "tie"]), "done")
    work.drop("proposed", "read-back")

    own = scan.select("id", "none", "n_words", "sha", tie.alias("tie"))
    firsts = scan.where(F.col("n_words") >= window).groupBy("sha").agg(F.min(F.struct("id", "none")).alias("first"))
    firsts = work.save(firsts, "firsts")  # a table, as above: the copies of one text may be a third of all rows
    out = own.join(firsts, "sha", "left").join(done, ["id", "none", "tie"], "left")
    copy = F.col("first") < F.struct("id", "none")
    whole = F.array(F.array(F.lit(0), F.col("n_words").cast("int")))
    return out.select(
        F.when(F.col("none") == 0, F.col("id")).alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<array<int>>"))).alias("spans"),
    )
