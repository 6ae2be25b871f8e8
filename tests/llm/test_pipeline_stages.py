"""Rows of each pipeline stage against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def base(k):
    return [f"w{k}.{i}" for i in range(60)]


def near(k):
    return " ".join([*base(k)[:30], "other", *base(k)[31:]])


TEXTS = [" ".join(base(0)), " ".join(base(1)), "  ".join(base(0)), near(1), near(0), " ".join(base(2)), "", None, "short one", "short  one", "é 中文 tail"]
ROWS = [(i, t, "en", "abc"[i % 3], 0) for i, t in enumerate(TEXTS)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_toxicity_keeps_what_labels_say(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join([*(f"w{k}" for k in rng.integers(0, 400, 60)), *(["scum", "vermin"] if i % 5 == 0 else [])]), "en", "a", 0) for i in range(600)]
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(600)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = pipeline.toxicity(spark, docs, str(tmp_path))
    assert sorted(tuple(r) for r in kept.collect()) == [r for r in rows if r[0] % 5]


def test_exact_dedup(spark, docs, sf_dir):
    first = {}
    for i, t, *_ in ROWS:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert ids(pipeline.exact_dedup(spark, docs, sf_dir)) == sorted(first.values())


def test_near_dedup(spark, docs, sf_dir):
    from test_operators import near_by_force

    assert ids(pipeline.near_dedup(spark, docs, sf_dir)) == [i for i, (_, _, kept) in near_by_force({r[0]: r[1] for r in ROWS}).items() if kept]


def copies_by_force():
    size, weight = Counter(), {"a": 1, "b": 2, "c": 3}
    for _, t, _, s, _ in ROWS:
        size[s] += len(WORD.findall(t or ""))
    full: set = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        over = {s for s in size if s not in full and weight[s] * level > 3 * size[s]}
        if not over:
            break
        full |= over
    rate = {s: (3.0 * size[s] if s in full else weight[s] * level) / size[s] for s in size}

    def luck(i, t, shift):
        draw = int(hashlib.md5(f"mix:{i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16)
        return (draw + shift * 16**13 // 32) % 16**13 / 16**13

    out = Counter()
    for s in size:
        own = [(i, t, len(WORD.findall(t or ""))) for i, t, _, source, _ in ROWS if source == s]
        copies = {k: {i: int(rate[s]) + (luck(i, t, k) < rate[s] - int(rate[s])) for i, t, _ in own} for k in range(32)}
        out.update(copies[min(range(32), key=lambda k: (abs(sum(copies[k][i] * n for i, _, n in own) - rate[s] * size[s]), k))])
    return +out


def test_mixing(spark, docs, sf_dir):
    assert Counter(ids(pipeline.mixing(spark, docs, sf_dir))) == copies_by_force()


def test_packing(spark, docs, sf_dir):
    from test_operators import ids_of

    got = Counter()
    for r in pipeline.packing(spark, docs, sf_dir).collect():
        got[r.doc_id] += r.length
    assert got == {i: len(ids_of("byte_bpe_50k.json", t or "")) + 1 for i, t, *_ in ROWS}


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES])
def test_odd_and_empty(spark, odd, empty, sf_dir, stage):
    assert stage(spark, empty, sf_dir).count() == 0
    want = {"toxicity": None, "exact_dedup": 8, "near_dedup": 7, "mixing": None, "packing": None}[stage.__name__]
    n = stage(spark, odd, sf_dir).count()
    assert n > 0 if want is None else n == want
