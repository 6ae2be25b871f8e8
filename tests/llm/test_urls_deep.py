"""The template tree against brute force, and branches far down the path."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest

from quirework.llm import urlfilter
from quirework.llm.queries import RULES, table


def general(s):
    if re.fullmatch("[0-9]+", s):
        return "{n}"
    if m := re.fullmatch(r"[0-9]+\.([A-Za-z0-9]{1,5})", s):
        return "{n}." + m[1]
    if re.fullmatch("[0-9a-fA-F]{8,}", s):
        return "{x}"
    return "{id}" if re.search("[0-9]", s) else "{long}" if len(s) > 40 else s


def verdicts_by_force(urls, rules):
    """verdict of each url: host and path, rules, wildcards from the top down, merges from the bottom up, all on plain lists."""
    z, rows = 1.96, []
    for url in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(t), t, w) for w, t in rules if (host == (d := t.partition("/")[0]) or host.endswith("." + d)) and path.startswith("/" + t.partition("/")[2])]
        rows.append((host, [general(s) for s in path.split("/") if s], max(fits)[2] if fits else None))
    depth = max((len(s) for _, s, _ in rows), default=0)
    templates = [list(s) for _, s, _ in rows]
    for k in range(depth):
        pages = defaultdict(lambda: defaultdict(int))
        for (host, _, _), t in zip(rows, templates):
            if len(t) > k:
                pages[host, tuple(t[:k])][t[k]] += 1
        open_ = {node for node, values in pages.items() if ((f := sum(n == 1 for n in values.values())) - z * math.sqrt(f)) / sum(values.values()) >= 0.2}
        for (host, _, _), t in zip(rows, templates):
            if len(t) > k and (host, tuple(t[:k])) in open_:
                t[k] = "*"
    merged = {(host, tuple(t)): tuple(t) for (host, _, _), t in zip(rows, templates)}
    labels = defaultdict(lambda: [0, 0])
    for (host, _, label), t in zip(rows, templates):
        if label:
            labels[host, tuple(t)][0] += 1
            labels[host, tuple(t)][1] += label == "block"

    def sums():
        out = defaultdict(lambda: [0, 0])
        for (host, t), m in merged.items():
            for i in (0, 1):
                out[host, m][i] += labels[host, t][i]
        return out

    for k in reversed(range(depth)):
        groups = defaultdict(list)
        for (host, m), (n, b) in sums().items():
            if len(m) > k and not re.fullmatch(r"[*~].*|\{.*", m[k]) and n >= 5:
                groups[host, (*m[:k], "~", *m[k + 1 :])].append((m, n, b))
        new = {}
        for (host, shape), own in groups.items():
            n_, b_ = sum(x[1] for x in own), sum(x[2] for x in own)
            p = (b_ + 1) / (n_ + 2)
            if len(own) > 1:
                new |= {(host, m): shape for m, n, b in own if abs(b / n - b_ / n_) <= z * math.sqrt(p * (1 - p) * (1 / n + 1 / n_))}
        merged = {(host, t): new.get((host, m), m) for (host, t), m in merged.items()}
    pool = sums()
    return [label or ("block" if ((x := pool[host, merged[host, tuple(t)]])[1] + 0.2) / (x[0] + 2) >= 0.8 else "allow") for (host, _, label), t in zip(rows, templates)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "c", "Shop", "x1", "77", "deadbeef00"]
    urls = [f"http://{rng.choice(['h.com', 'www.h.com', 'g.net'])}/" + "/".join([*rng.choice(names, rng.integers(0, 9)), *([f"slug-{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"] * int(rng.integers(0, 2)))]) for i in range(700)]
    rules = [("block", "h.com/a/"), ("allow", "h.com/a/b"), ("block", "net/Shop/"), ("allow", "www.h.com/c/"), ("block", "com/b/a/"), ("allow", "com/b/c/a")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3)
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(pages, rules).collect()}
    assert [got[i] for i in range(len(urls))] == verdicts_by_force(urls, rules)


def test_pages_against_brute_force(spark):
    rows = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url").collect()
    want = verdicts_by_force([r.url for r in rows], RULES)
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(table(spark, "/root/testdata/sf0.01", "pages"), RULES).collect()}
    assert [got[r.page_id] for r in rows] == want


def test_deep_branches_are_judged_apart(spark):
    rows = [(i, f"http://h.com/a/b/c/d/e/f/{b}/{i}") for i in range(40) for b in ("bad", "good")]
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), [("block", "h.com/a/b/c/d/e/f/bad/")]).collect()
    assert {(r.path.split("/")[7], r.verdict) for r in got} == {("bad", "block"), ("good", "allow")}


def test_upper_levels_are_merged(spark):
    """Below en and fr alike, news and sport are blocked: both levels become one template, which then judges what has no label."""
    rows = [(i, f"http://h.com/{a}/{b}/{i}") for i in range(12) for a in ("en", "fr") for b in ("news", "sport")]
    rules = [("block", f"h.com/{a}/{b}/{i}") for a in ("en", "fr") for b in ("news", "sport") for i in range(2, 10)]
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()
    assert {(r.verdict, r.template) for r in got} == {("block", "/~/~/{n}")}


def test_very_long_urls_and_columns_named_like_outputs(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://h.com/" + "/".join(f"p{'q' * (i % 3)}" for i in range(3000))), (2, "http://h.com/" + "x" * 100_000), (3, "http://h.com/a"), (3, "http://h.com/a"), (None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    for c in ("host", "path", "rule", "verdict", "segments", "template", "label", "pages", "merged", "node"):
        pages = pages.withColumn(c, F.lit(7))
    got = urlfilter.judge_urls(pages, RULES).collect()
    assert len(got) == 5 and {r.verdict for r in got} == {"allow"} and {len(r.path) for r in got} >= {0, 2, 100_001}
