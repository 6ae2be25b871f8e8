"""Each operator against a brute-force version, and on odd and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import exactdedup, mixing, neardedup, packing, quality, substring, tokenfile, toolcalls, toxicity, urlfilter
from quirework.llm.queries import RULES, TOOLS, table, vocabulary
from quirework.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def ids_of(name, text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(name))
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("hist", [np.zeros(65, np.int64), np.bincount([64, 1, 63, 32, 32, 20, 20, 24, 7], minlength=65), np.random.default_rng(0).integers(0, 50, 65)])
def test_combinations_fill_the_window_and_spend_no_more_than_there_is(hist):
    hist[[0, 64]] = 0
    used = Counter()
    for lengths, n in packing.solve(hist, 64):
        assert sum(lengths) == 64 and n > 0
        used.update({a: n * lengths.count(a) for a in set(lengths)})
    assert all(used[a] <= hist[a] for a in used)
    found = packing.combinations(64, hist > 0)
    counts, left = packing.fit(hist, found)
    assert (counts >= 0).all() and packing.breach(counts, left, found).max(initial=0) <= max(0.5, packing.TOLERANCE * hist.max())
    again = hist.astype(float)
    np.subtract.at(again, found.ravel(), np.repeat(counts, 3))
    assert np.allclose(again[1:], left[1:])
    packed = packing.solve(hist, 64)
    assert packing.cuts(hist, 64, packed) <= packing.cuts(hist, 64, [])


def test_the_fit_saves_cuts():
    hist = np.bincount(np.random.default_rng(1).lognormal(5.5, 1, 20000).astype(int) % 1023 + 1, minlength=1025)  # tails of documents
    assert packing.cuts(hist, 1024, packing.solve(hist, 1024)) < 0.2 * packing.cuts(hist, 1024, [])


def check_packing(rows, want):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_row].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    got = []
    for own in by_doc.values():
        own.sort(key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in own)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert all(len(r.ids) == 2 * r.length for r in own)
        got.append(np.frombuffer(ids, "<u2").tolist())
    assert sorted(got) == sorted(want)
    room = 0
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own[:-1]]))
        total = sum(n for _, n in own)
        assert total <= 1024
        room += 1024 - total
    assert room < 1024


def test_packing(docs, texts):
    pieces = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))
    check_packing(pieces.collect(), [ids_of("byte_bpe_50k.json", t) + [0] for t in texts.values()])
    ids = {i: ids_of("byte_bpe_50k.json", t) + [0] for i, t in texts.items()}
    for r in packing.with_crc32(pieces).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_packing_odd(odd, empty):
    rows = odd.select("text").collect()
    check_packing(packing.pack_documents(odd, vocabulary("byte_bpe_50k.json")).collect(), [ids_of("byte_bpe_50k.json", r.text or "") + [0] for r in rows])
    assert packing.pack_documents(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_url_rules(spark, sf_dir):
    for r in urlfilter.judge_urls(table(spark, sf_dir, "pages"), RULES).join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(text), what, text) for what, text in RULES if (host == (d := text.partition("/")[0]) or host.endswith("." + d)) and path.startswith("/" + text.partition("/")[2])]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[2] if fits else None)
        assert r.verdict == (max(fits)[1] if fits else r.verdict) and r.verdict in ("allow", "block")


def test_url_templates(spark):
    rows = [(i, f"http://h.com/{b}/{i}") for i in range(40) for b in ("en", "x", "y")] + [(900, None), (901, "no scheme"), (902, "HTTP://H.com?q"), (902, "HTTP://H.com?q")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = urlfilter.judge_urls(pages, [("block", "com/en/1"), ("block", "com/en/2"), ("block", "com/x/1"), ("block", "com/x/2")]).collect()
    assert len(got) == len(rows)
    # en and x are alike, merged and rejected as one; y has no label and stays
    assert {r.verdict for r in got if r.path.startswith(("/en/", "/x/"))} == {"block"}
    assert {r.verdict for r in got if not r.path.startswith(("/en/", "/x/"))} == {"allow"}
    assert {(r.host, r.path) for r in got if r.page_id in (900, 901)} == {("", "")}
    assert urlfilter.judge_urls(pages.limit(0), RULES).count() == 0


def test_common_lines_go_and_depleted_documents_with_them(spark, odd, empty):
    own = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Shared LINE here\n{own} {i}", "h") for i in range(6)] + [(10, "\n".join(["shared  line here"] * 1 + ["other words " * 30]), "h")] + [(i, "shared line here\n" + own, "g") for i in (20, 21)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    judged = quality.judge_lines(docs, most_documents=3)
    by = {r.doc_id: r for r in judged.collect()}
    assert [by[i].n_common_words for i in (0, 10, 20)] == [3, 3, 0]
    assert by[0].kept and not by[10].kept and by[20].kept
    assert {r.text for r in quality.remove_lines(docs, judged).where("doc_id = 0").collect()} == {own + " 0"}
    got = {(r.doc_id, r.n_words) for r in quality.judge_lines(odd).collect()}
    assert {(2, 0), (1, 0), (3, 2), (4, 20000), (9, 0)} <= got
    assert quality.judge_lines(empty).count() == 0
    judged = quality.judge_lines(odd)
    assert quality.remove_lines(odd, judged).columns == odd.columns and quality.remove_lines(odd, judged).count() == judged.where("kept").count()


def test_toxicity_on_documents_held_out(spark, odd, empty):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1200):
        toxic = int(rng.random() < 0.2)
        own = list(rng.choice(words, 60)) + (list(rng.choice(["Scum!", "vermin,", "MORON"], 2)) if toxic else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, int(rng.random() < 0.8), toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in toxicity.judge(docs, known.where("doc_id < 800")).collect()}
    wrong = sum(got[i] == bool(t) for i, _, t in labels if i >= 800)
    assert wrong <= 4
    out = toxicity.judge(odd, known).collect()
    assert len(out) == 11 and all(0 <= r.p_toxic <= 1 for r in out) and out[0].id == "x"
    assert toxicity.judge(empty, known).count() == 0
    assert {r.kept for r in toxicity.judge(docs, known.limit(0)).collect()} == {True}


def chain_by_force(texts, labels):
    """The chain in plain Python words and full gradient descent, far more steps of it, on dense matrices."""
    words = {i: set(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower())) for i, t in texts.items()}
    ids = sorted(i for i in labels if i in texts)
    held = Counter(w for i in ids for w in words[i])
    common = sorted(w for w, n in held.items() if n >= toxicity.LEAST_DOCUMENTS)
    place = {w: k for k, w in enumerate(common)}
    dense = lambda own: np.array([[w in words[i] for w in common] for i in own], float)
    x, every = dense(ids), list(texts)

    def one(y, use, before):
        x_, b_, y_ = x[use], before[use], y[use]
        p, q = (x_[y_ == k].sum(0) for k in (1, 0))
        m, n = (y_ == 1).sum(), (y_ == 0).sum()
        pool = (p + q + 1) / (m + n + 2)
        z = np.abs((p + 0.5) / (m + 1) - (q + 0.5) / (n + 1)) / np.sqrt(pool * (1 - pool) * (1 / m + 1 / n))
        best = [k for k in np.argsort(-z, kind="stable")[: toxicity.TELLING] if z[k] >= toxicity.LEAST_Z]
        f = np.column_stack((x_[:, best], b_, np.ones(len(x_))))
        weight, w = np.where(y_ == 1, 0.5 / m, 0.5 / n), np.zeros(f.shape[1])
        for _ in range(20000):
            g = f.T @ ((1 / (1 + np.exp(-f @ w)) - y_) * weight)
            g[: len(best)] += toxicity.PENALTY * w[: len(best)]
            w -= g * 4 / (weight @ (f**2).sum(1))
        return lambda x, before: 1 / (1 + np.exp(-np.column_stack((x[:, best], before, np.ones(len(x)))) @ w))

    before, final, out = np.zeros((len(ids), 0)), np.zeros((len(every), 0)), []
    for c in range(2):
        y = np.array([labels[i][c] for i in ids], float)
        p = np.zeros(len(ids))
        for k in range(toxicity.FOLDS):
            use = np.arange(len(ids)) % toxicity.FOLDS != k
            p[~use] = one(y, use, before)(x, before)[~use]
        final = np.column_stack((final, one(y, np.ones(len(ids), bool), before)(dense(every), final)))
        before = np.column_stack((before, p))
        out.append(toxicity.limit(p, y.astype(bool)))
    assert place
    return dict(zip(every, final.tolist(), strict=True)), out[-1]


def test_toxicity_against_plain_gradient_descent(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want, limit = chain_by_force(texts, {r.doc_id: (1 - r.quality, r.toxic) for r in labels.collect()})
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i].p_toxic - p[1]) for i, p in want.items()) < 0.02
    assert np.mean([abs(got[i].p_low_quality - p[0]) for i, p in want.items()]) < 0.005
    assert [i for i, p in want.items() if got[i].kept != (p[1] < limit) and abs(p[1] - limit) > 0.1] == []


def test_toxicity_with_repeated_ids(spark):
    """A labelled id with many rows counts once in the sample; each row is scored by its own text."""
    rows = [(i, " ".join(["scum"] * (i % 2) + [f"w{i % 7}", f"v{i % 5}", "common"])) for i in range(200)] + [(1, "scum again"), (0, "plain")] * 300
    labels = [(i, 1, i % 2) for i in range(200)] + [(3, 0, 0), (None, 1, 1)]
    got = toxicity.judge(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == 800 and all(r.kept != ("scum" in r.text) for r in got)


def spans_by_force(rows, window=50):
    first, words = {}, {}
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in rows:
        words[i, text] = w = tuple((text or "").encode().split())
        for p in range(len(w) - window + 1):
            first.setdefault(w[p : p + window], (i is None, i or 0))
    out = {}
    for key, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[w[p : p + window]] < (key[0] is None, key[0] or 0):
                gone[p : p + window] = [True] * window
        out[key] = (len(w), sum(gone), hashlib.sha256(b" ".join([x for x, g in zip(w, gone, strict=True) if not g])).hexdigest())
    return out


def test_repeated_passages(spark, docs, texts):
    want = spans_by_force(list(texts.items()))
    for r in substring.repeated_spans(docs).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id, texts[r.doc_id]]


def test_repeated_passages_made_hard(spark):
    """Passages cut, joined, repeated in place, and words that repeat."""
    rng = np.random.default_rng(5)
    passages = [[f"p{k}.{i}" for i in range(rng.integers(40, 140))] for k in range(4)] + [["a"] * 130, ["a", "b"] * 60]
    rows = []
    for i in range(120):
        own = []
        for _ in range(rng.integers(0, 5)):
            p = passages[rng.integers(len(passages))]
            at = rng.integers(0, 40)
            own += p[at : len(p) - rng.integers(0, 30)] + [f"u{i}.{j}" for j in range(rng.integers(0, 12))]
        rows.append((int(i), " ".join(own)))
    want = spans_by_force(rows)
    texts = dict(rows)
    for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id, texts[r.doc_id]]


def test_repeated_passages_odd(spark, odd, empty):
    want = spans_by_force([(r.doc_id, r.text) for r in odd.collect()])
    got = substring.repeated_spans(odd).collect()
    assert sorted(((r.n_words, r.n_removed, r.kept_sha256) for r in got)) == sorted(want[r.doc_id, r.text] for r in odd.collect())
    assert substring.repeated_spans(empty).count() == 0


def test_repeated_passages_of_null_and_extreme_ids(spark):
    """Nulls come after the largest id, and rows with one id keep what they share."""
    top = (1 << 63) - 1
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join([f"{k}.{j}" for j in range(7)] + passage[k % 3 :] + [f"{k}:{j}" for j in range(5)])) for k, i in enumerate([None, top, None, -5, top, 3, -(1 << 63)])]
    for use in (rows, rows[:3], rows[:5]):
        want = spans_by_force(use)
        got = substring.repeated_spans(spark.createDataFrame(use, "doc_id bigint, text string").repartition(3)).collect()
        assert sorted((r.doc_id or 0, r.doc_id is None, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((i or 0, i is None, *want[i, t]) for i, t in use)


def test_spans_that_differ_from_their_source_stay(spark, monkeypatch):
    """Window and edge hashes that are all alike propose everything; the words decide."""
    path = {"pos": [0], "path": [None], "least": [None], "joined": [None], "last": [None]}
    starts = [{"pos": k, "id": 1, "place": substring._place(k + 4, 0, 9)} for k in (2, 3, 4, 7)]
    assert substring._spans(path, starts, (5, 0), 50, 10) == [(2, 52, 1, substring._place(6, 0, 9)), (7, 50, 1, substring._place(11, 0, 9))]
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(60))
    tie = substring._tie(substring._digest(text.encode()))
    right = substring._span_digest(text.encode().split(), 3, 50)
    batch = pa.RecordBatch.from_pylist([{"id": 2, "none": 0, "tie": tie, "text": text, "spans": [{"at": 3, "length": 50, "digest": d}]} for d in (right, b"x" * 16)])
    assert next(substring._finish(iter([batch]))).column("n_removed").to_pylist() == [50, 0]


def test_tool_calls(spark):
    calls = [("a", None, 0, "respond", '{"query":"q","n_words":1}'), ("b", "a", 1, "respond", '{"n_words": 2, "query": "r"}'), ("c", "b", 2, "respond", '{"query":1,"n_words":2}'), ("d", "e", 3, "respond", "{}"),
             ("e", "d", 4, "respond", "{}"), ("f", "zz", 5, "other", "{}"), ("g", "c", 6, "respond", "not json"), (None, None, 7, "respond", None), ("a", None, 9, "respond", "{}")]
    results = [("a", 10, "ra"), ("b", 11, None), ("b", 12, "later"), ("x", 13, "lost"), (None, 14, "unnamed")]
    got = toolcalls.link(spark.createDataFrame(calls, "call_id string, after string, position int, tool string, arguments string"), spark.createDataFrame(results, "call_id string, position int, content string"), TOOLS).collect()
    by = defaultdict(list)
    for r in got:
        by[r.call_id].append((r.status, r.depth))
    assert sorted(by["a"]) == [("duplicate", 0), ("linked", 0)] and sorted(by["b"]) == [("linked", 1), ("orphan_result", 0)]
    assert by["c"] == [("bad_arguments", 2)] and by["d"] == [("cycle", -1)] and by["e"] == [("cycle", -1)] and by["f"] == [("bad_arguments", 0)]
    assert by["g"] == [("bad_arguments", 3)] and by["x"] == [("orphan_result", 0)] and sorted(by[None]) == [("no_result", 0), ("orphan_result", 0)]
    assert next(r.event for r in got if r.call_id == "a" and r.event) == '{"arguments":{"n_words":1,"query":"q"},"call_id":"a","result":"ra","tool":"respond"}'


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, odd, empty, encoding):
    work = Workspace(spark)
    tokenfile.write_tokens(odd, f"{work.root}/tokens", vocabulary("word_bpe_49k.json"), end_id=2, files=3, encoding=encoding)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, ids_of("word_bpe_49k.json", r.text or "") + [2]) for r in odd.collect()), key=lambda x: x[:2])
    got = tokenfile.read_tokens(spark, f"{work.root}/tokens").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.tokens)) for r in got) == sorted(want)
    index = sorted(tokenfile.read_index(spark, f"{work.root}/tokens").collect(), key=lambda r: r.start)
    assert [r.start for r in index] == list(np.cumsum([0] + [r.n_tokens for r in index[:-1]]))
    assert [(r.doc_id is not None, r.doc_id or 0) for r in index] == [x[:2] for x in want]
    crc = {(r.doc_id, r.ids_crc32) for r in tokenfile.checksums(spark, f"{work.root}/tokens").collect()}
    assert crc == {(i if known else None, zlib.crc32(np.array(ids, "<u4").tobytes())) for known, i, ids in want}
    assert {r.doc_id for r in tokenfile.read_tokens(spark, f"{work.root}/tokens", 5, 6).collect()} == {5, 6}
    tokenfile.write_tokens(empty, f"{work.root}/none", vocabulary("word_bpe_49k.json"), end_id=2)
    assert tokenfile.checksums(spark, f"{work.root}/none").count() == 0


def test_token_files_of_documents(spark, docs, texts):
    """Starts, counts and checksums of the whole table, and what the files' footers say of encodings, row groups and indexes."""
    import glob

    import pyarrow.parquet as pq

    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        work = Workspace(spark)
        path = f"{work.root}/tokens"
        tokenfile.write_tokens(docs, path, vocabulary("word_bpe_49k.json"), end_id=2, files=3, encoding=encoding, row_group_mb=1, page_kb=16)
        start, want = 0, {}
        for i in sorted(texts):
            ids = ids_of("word_bpe_49k.json", texts[i]) + [2]
            want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        index = {r.doc_id: (r.start, r.n_tokens) for r in tokenfile.read_index(spark, path).collect()}
        assert {r.doc_id: (*index[r.doc_id], r.ids_crc32) for r in tokenfile.checksums(spark, path).collect()} == want
        groups = 0
        for file in glob.glob(path.removeprefix("file://") + "/*.parquet"):
            footer = pq.ParquetFile(file).metadata
            groups += footer.num_row_groups
            for g in range(footer.num_row_groups):
                columns = {footer.row_group(g).column(c).path_in_schema: footer.row_group(g).column(c) for c in range(footer.num_columns)}
                tokens = next(c for p, c in columns.items() if p.startswith("tokens"))
                assert any(name in e or e == name.replace("RLE_", "PLAIN_") for e in tokens.encodings)
                assert tokens.has_column_index and tokens.has_offset_index and columns["doc_id"].has_column_index
                assert footer.row_group(g).total_byte_size < 4 << 20
        assert groups >= 3
        rows = tokenfile.read_tokens(spark, path, 5, 6)
        assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,5), LessThanOrEqual(doc_id,6)]" in rows._jdf.queryExecution().toString()


def test_ids_that_do_not_fit_are_an_error():
    from quirework.llm.encoding import Encoder

    with pytest.raises(ValueError, match="1 bytes"):
        Encoder(vocabulary("byte_bpe_50k.json"), "<u1")


def test_exact_groups(spark, odd, empty):
    rows = [(int(i), f"text  {i % 3}" if i % 4 else None) for i in range(400)]
    got = {r.doc_id: r for r in exactdedup.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), partitions=7).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    for t, own in groups.items():
        for i in own:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(own), len(own), i == min(own), hashlib.sha256(t.encode()).hexdigest())
    by = {(r.doc_id, r.keep_id, r.group_size) for r in exactdedup.exact_groups(odd).collect()}
    assert {(1, 1, 2), (2, 1, 2), (5, 5, 3), (6, 5, 3), (None, 5, 3), (7, 7, 2)} <= by
    assert exactdedup.drop_duplicates(odd).count() == 8 and exactdedup.drop_duplicates(empty).count() == 0


def near_by_force(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for k, i in enumerate(keys):
        for j in keys[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in keys}


@pytest.mark.parametrize("large", [False, True])
def test_near_groups(spark, odd, empty, large):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(90 if large else 30):
        own = list(base) if large else [f"g{i // 4}.{j}" for j in range(120)]
        for at in rng.integers(0, len(own), rng.integers(0, 6)):
            own[at] = f"x{i}.{at}"
        texts[i] = " ".join(own)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == near_by_force(texts)
    if not large:
        by = {r.doc_id: r for r in neardedup.near_groups(odd).collect()}
        assert by[1].kept and by[2].kept and by[3].n_shingles == 1 and by[6].component_id == 5 and by[7].component_id == 5
        assert neardedup.near_groups(empty).count() == 0


def test_mixing(docs, odd, empty):
    rows = mixing.mix(docs).collect()
    sources = sorted({r.source for r in rows})
    sizes = {s: sum(r["size"] for r in rows if r.source == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in sources}
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        assert r["size"] == len(WORD.findall(r.text or "")) and abs(r.copies - r.target / max(1, r.source_size)) < 1
    assert mixing.mix(docs).select("doc_id", "copies").exceptAll(docs.sparkSession.createDataFrame([(r.doc_id, r.copies) for r in rows], "doc_id bigint, copies bigint")).count() == 0
    every = mixing.mix(table(docs.sparkSession, "/root/testdata/sf0.01", "documents")).selectExpr("source", "target", "copies * size AS taken").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.1 * r.target for r in every)
    assert mixing.mix(odd).count() == 11 and mixing.mixed(odd).columns == odd.columns and mixing.mix(empty).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    offsets = defaultdict(list)
    for r in rows:
        offsets[r.sequence_id].append((r.offset, r.length))
    for own in offsets.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own[:-1]])) and sum(n for _, n in own) <= 1024
    assert corpus_pipeline.toxicity(spark, table(spark, sf_dir, "documents"), sf_dir).where(F.col("doc_id").isNull()).count() == 0
