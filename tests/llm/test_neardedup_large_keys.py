"""Near duplicates whose shared keys are large: no link rests on how large."""

import numpy as np
import pytest

from quirework.llm import neardedup
from quirework.llm.workspace import Workspace
from test_neardedup_ids import SCHEMA, check, words


@pytest.mark.parametrize(("small", "rich"), [(1, 1), (2, 4), (3, 16)])
def test_no_link_rests_on_the_limits(spark, monkeypatch, small, rich):
    """With hardly any key small, classes free of large keys in RICH chunks must still meet all partners."""
    monkeypatch.setattr(neardedup, "SMALL", small)
    monkeypatch.setattr(neardedup, "RICH", rich)
    rng = np.random.default_rng(3)
    rows = []
    for g, size in enumerate([1] * 10 + [2] * 10 + [4] * 8 + [9] * 3 + [30]):
        own = [f"g{g}.{j}" for j in range(100)]
        for _ in range(size):
            for at in rng.integers(0, 100, 2):
                own[at] = f"x{len(rows)}.{at}"
            rows.append((len(rows), " ".join(words("p", 10) + own)))
    check(spark.createDataFrame(rows, SCHEMA).repartition(3))


def signatures(spark, rows):
    return spark.createDataFrame([(i, 100, bytearray(s.astype("<u2").tobytes())) for i, s in enumerate(rows)], "id bigint, n bigint, signature binary").repartition(3)


def left_out(spark, rows):
    """Pairs nearer than DISTANCE that are no candidates and not two owners with a large key in common."""
    work = Workspace(spark)
    pairs, owners = neardedup._candidates(signatures(spark, rows), 75, work)
    met = {(r.a, r.b) for r in pairs.collect()}
    keys = {r.id: {k.key for k in r["keys"]} for r in owners.collect()}
    work.clear()
    far = neardedup.distances(np.array(rows), np.array(rows))
    near = {(int(a), int(b)) for a, b in np.argwhere(far < neardedup.DISTANCE) if a < b}
    return {(a, b) for a, b in near - met if not keys.get(a, set()) & keys.get(b, set())}, near


def fresh(rng, n=1):
    return rng.integers(0, 1 << 16, (n, neardedup.SLOTS))


def test_a_pair_that_meets_in_a_large_key_only(spark):
    """One chunk in common, which twenty others have too, and two slots of every other chunk."""
    rng = np.random.default_rng(1)
    a = fresh(rng)[0]
    b = a.copy()
    for chunk in range(1, neardedup.CHUNKS):
        b[chunk * 4 + rng.permutation(4)[:2]] = fresh(rng)[0][:2]
    others = fresh(rng, 20)
    others[:, :4] = a[:4]
    lost, near = left_out(spark, [a, b, *others])
    assert (0, 1) in near and not lost


@pytest.mark.parametrize("common", [4, 12, 20, 40])
def test_pairs_at_every_distance(spark, common):
    """Many classes share some slots, as those of a common passage do; partners differ in up to 39."""
    rng = np.random.default_rng(common)
    passage, rows = fresh(rng)[0], []
    for i in range(150):
        own = fresh(rng)[0]
        at = rng.permutation(neardedup.SLOTS)[:common] if i % 2 else np.arange(common)
        own[at] = passage[at]
        other = own.copy()
        moved = rng.permutation(neardedup.SLOTS)[: int(rng.integers(30, 40))]
        other[moved] = fresh(rng)[0][moved]
        rows += [own, other]
    lost, near = left_out(spark, rows)
    assert len(near) >= 150 and not lost
