"""Near duplicates among rows whose ids are null or repeat, whole tables, and what large keys can miss."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from quirework.llm import neardedup
from quirework.llm.queries import table

SCHEMA = "doc_id bigint, text string"


def words(name, n=120):
    return [f"{name}{i}" for i in range(n)]


def near(name, at=60):
    own = words(name)
    own[at] = "changed"
    return " ".join(own)


def rest(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in neardedup.drop_near_duplicates(docs).collect()), key=repr)


def expected(rows):
    return sorted(((i is None, i or 0, t) for i, t in rows), key=repr)


def test_null_ids_are_unrelated(spark):
    stay = [(1, " ".join(words("a"))), (None, " ".join(words("b"))), (None, " ".join(words("c"))), (None, ""), (None, None)]
    assert rest(spark, [*stay, (None, near("a"))]) == expected(stay)
    got = neardedup.near_groups(spark.createDataFrame([*stay, (None, near("a"))], SCHEMA)).collect()
    assert sorted((r.component_id or 0, r.kept) for r in got) == [(0, True)] * 4 + [(1, False), (1, True)]


def test_null_id_copies_meet(spark):
    left = rest(spark, [(None, " ".join(words("a"))), (None, near("a")), (None, " ".join(words("b")))])
    assert len(left) == 2 and expected([(None, " ".join(words("b")))])[0] in left


def test_repeated_ids_are_judged_by_their_texts(spark):
    stay = [(1, " ".join(words("a"))), (2, " ".join(words("b"))), (3, " ".join(words("c")))]
    assert rest(spark, [*stay, (3, near("b")), (3, near("a")), (4, near("c"))]) == expected(stay)


def test_both_texts_of_an_id_keep_their_links(spark):
    a, b = " ".join(words("a")), " ".join(words("b"))
    got = neardedup.near_groups(spark.createDataFrame([(7, a), (7, b), (8, b + " end"), (9, a + " end")], SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False)]


def test_the_largest_id_is_no_null(spark):
    top = (1 << 63) - 1
    got = neardedup.near_groups(spark.createDataFrame([(top, " ".join(words("a"))), (None, near("a")), (None, near("b")), (0, "one two")], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(top, top, True), (None, top, False), (None, None, True), (0, 0, True)}


def test_same_set_other_text(spark):
    rows = [(None, " ".join(words("a"))), (None, "  ".join(words("a")))]
    assert len(rest(spark, rows)) == 1
    assert len(rest(spark, [(5, " ".join(words("b"))), *rows])) == 2


def components_by_force(texts):
    """Counts common shingles of every pair that has one, so nothing rests on signatures."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, held = {}, defaultdict(list)
    for i, t in texts.items():
        w = tuple((t or "").translate(lower).encode().split())
        sets[i] = {w[j : j + 5] for j in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            held[s].append(i)
    both = Counter((a, b) for own in held.values() if len(own) > 1 for k, a in enumerate(own) for b in own[k + 1 :])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def check(docs):
    want = components_by_force({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardedup.near_groups(docs).collect()}
    wrong = {i for i in want if got[i] != want[i]}
    assert not wrong and len(got) == len(want)


def test_documents(spark):
    """Every component of a whole table as brute force finds it: recall and precision of the links are 1."""
    check(table(spark, "/root/testdata/sf0.01", "documents"))


@pytest.mark.parametrize("seed", [1, 2])
def test_common_passage_and_groups(spark, seed):
    """Large keys: a passage that all texts have, and groups of near copies from two to many, chained by small steps."""
    rng = np.random.default_rng(seed)
    passage, rows = words("p", 90), []
    for g, size in enumerate([1] * 40 + [2] * 10 + [5] * 4 + [60]):
        own = [f"g{g}.{j}" for j in range(int(rng.integers(60, 130)))]
        for _ in range(size):
            for at in rng.integers(0, len(own), int(rng.integers(0, 4))):
                own[at] = f"x{len(rows)}.{at}"
            rows.append((len(rows), " ".join(passage + own)))
    order = rng.permutation(len(rows))
    check(spark.createDataFrame([(int(order[i]), t) for i, t in rows], SCHEMA).repartition(3))


def test_what_a_class_without_large_keys_can_miss():
    """Two sets of similarity 0.75 that share a passage: the keys inside the passage are the large ones.

    The chance that RICH chunks of one class are free of large keys and none of
    these chunks brings the pair together, from the chance of each number of a
    chunk's slots in the passage.
    """
    for share in np.arange(0, 0.76, 0.05):
        equal = (0.75 - share) / (1 - share)  # of the slots outside the passage
        free = good = 0.0
        for k in range(3):  # three slots in the passage would make a large key
            p = math.comb(4, k) * share**k * (1 - share) ** (4 - k)
            m = 4 - k
            free += p
            good += p * (equal**m + m * (1 - equal) * equal ** (m - 1))
        missed = sum(math.comb(20, c) * (free - good) ** c * (1 - free) ** (20 - c) for c in range(neardedup.RICH, 21))
        assert missed < 1e-6
