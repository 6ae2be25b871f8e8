"""Registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A file of the public tokenizers that are installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.llm.packing import pack_documents, with_crc32

    pieces = pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), window=1024, end_id=0)
    return with_crc32(pieces.drop("doc_row"))


#: (verdict, host/path); the longest rule that fits a url wins.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.llm.urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.llm.quality import judge_lines

    rows = judge_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The one tool that plain chat turns call, as field -> (type, required).
TOOLS = {"respond": {"query": ("string", True), "n_words": ("integer", True)}}


def op6_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.llm.toolcalls import link_turns

    return link_turns(table(spark, sf_dir, "conversations"), TOOLS)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.llm.toxicity import judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).drop("text")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.llm.substring import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


#: Token files whose first positions are sent to every task; those of more are joined by a shuffle.
BROADCAST_FILES = 100_000


def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.llm.tokenfile import checksums, read_index, write_tokens
    from quirework.llm.workspace import Workspace

    path = Workspace(spark).root + "/tokens"
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    bases = read_index(spark, path).groupBy("part").agg(F.min("start").alias("base"))
    if len(spark.read.parquet(path).inputFiles()) <= BROADCAST_FILES:
        bases = F.broadcast(bases)  # one row a file
    rows = checksums(spark, path).join(bases, "part")
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op8_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.llm.exactdedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op9_neardedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.llm.neardedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.llm.mixing import mix

    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_urlfilter": op2_urlfilter,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_substring": op5_substring,
    "op6_toolcalls": op6_toolcalls,
    "op7_tokenfile": op7_tokenfile,
    "op8_exactdedup": op8_exactdedup,
    "op9_neardedup": op9_neardedup,
    "op10_mixing": op10_mixing,
}

def _levels() -> str:
    """op2's walk over four levels: wildcards from the top down (t1 to t4), merges from the bottom up (b1 to b4)."""
    parts = []
    for k in range(4):
        parts.append(f"""v{k} AS (SELECT host, pre FROM (SELECT host, tpl[1:{k}] AS pre, tpl[{k + 1}] AS v, sum(pages) AS p FROM t{k} WHERE len(tpl) > {k} GROUP BY ALL) GROUP BY host, pre
            HAVING (count(*) FILTER (WHERE p = 1) - 1.96 * sqrt(count(*) FILTER (WHERE p = 1))) / sum(p) >= 0.2),
        t{k + 1} AS (SELECT t.host, t.seg, t.pages, t.n, t.b, CASE WHEN v.host IS NOT NULL THEN list_transform(t.tpl, lambda s, i: CASE WHEN i = {k + 1} THEN '*' ELSE s END) ELSE t.tpl END AS tpl
            FROM t{k} t LEFT JOIN v{k} v ON v.host = t.host AND v.pre = t.tpl[1:{k}] AND len(t.tpl) > {k}),""")
    parts.append("b0 AS (SELECT host, tpl, tpl AS mrg, sum(n) AS n, sum(b) AS b FROM t4 GROUP BY host, tpl),")
    for i, k in enumerate(reversed(range(4))):
        parts.append(f"""k{i} AS (SELECT host, mrg, list_transform(mrg, lambda s, i: CASE WHEN i = {k + 1} THEN '~' ELSE s END) AS shape, sum(n) AS n, sum(b) AS b FROM b{i}
            WHERE NOT regexp_matches(coalesce(mrg[{k + 1}], '*'), '^([*~]|\\{{.*)$') GROUP BY host, mrg HAVING sum(n) >= 5),
        q{i} AS (SELECT host, shape, sum(n) AS n, sum(b) AS b FROM k{i} GROUP BY host, shape HAVING count(*) > 1),
        s{i} AS (SELECT k.host, k.mrg, k.shape FROM k{i} k JOIN q{i} q USING (host, shape)
            WHERE abs(k.b / k.n - q.b / q.n) <= 1.96 * sqrt((q.b + 1) / (q.n + 2) * (1 - (q.b + 1) / (q.n + 2)) * (1 / k.n + 1 / q.n))),
        b{i + 1} AS (SELECT b.host, b.tpl, coalesce(s.shape, b.mrg) AS mrg, b.n, b.b FROM b{i} b LEFT JOIN s{i} s ON s.host = b.host AND s.mrg = b.mrg),""")
    return "\n        ".join(parts).rstrip(",")


ORACLES: dict[str, str] = {
    "op2_urlfilter": """
        WITH r(verdict, rule, domain, start) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
             ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
        p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        m AS (SELECT p.*, (SELECT arg_max({'rule': r.rule, 'verdict': r.verdict}, length(r.rule)) FROM r
              WHERE (p.host = r.domain OR ends_with(p.host, '.' || r.domain)) AND starts_with(p.path, r.start)) AS x FROM p),
        g AS (SELECT page_id, host, path, x.rule AS rule, x.verdict AS label,
              list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE
                WHEN regexp_matches(s, '^[0-9]+$') THEN '{n}' WHEN regexp_matches(s, '^[0-9]+\\.[A-Za-z0-9]{1,5}$') THEN '{n}.' || regexp_extract(s, '\\.(.*)$', 1)
                WHEN regexp_matches(s, '^[0-9a-fA-F]{8,}$') THEN '{x}' WHEN regexp_matches(s, '[0-9]') THEN '{id}' WHEN length(s) > 40 THEN '{long}' ELSE s END) AS seg FROM m),
        t0 AS (SELECT host, CASE WHEN len(seg) > 4 THEN error('this statement walks four levels') ELSE seg END AS seg, seg AS tpl, count(*) AS pages, count(label) AS n, count(*) FILTER (WHERE label = 'block') AS b FROM g GROUP BY host, seg),
"""
    + _levels()
    + """
        SELECT page_id, host, path, rule, coalesce(label, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict
        FROM g JOIN (SELECT host, seg, tpl FROM t4) l USING (host, seg) JOIN b4 USING (host, tpl) JOIN (SELECT host, mrg, (sum(b) + 0.2) / (sum(n) + 2.0) AS purity FROM b4 GROUP BY host, mrg) u USING (host, mrg)""",
    "op3_quality": """
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
        h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
        r AS (SELECT doc_id, sum(c) AS n_repeat FROM (SELECT doc_id, least(3, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 3)) AS c FROM h WHERE n > 1) GROUP BY doc_id),
        l AS (SELECT doc_id, source, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS line FROM d),
        m AS (SELECT doc_id, source, line, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm FROM l),
        c AS (SELECT source, norm FROM (SELECT DISTINCT doc_id, source, norm FROM m) GROUP BY source, norm HAVING count(*) > 100),
        x AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup,
                     coalesce(sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) FILTER (WHERE c.norm IS NOT NULL), 0) AS gone
              FROM m LEFT JOIN c ON m.norm = c.norm AND m.source IS NOT DISTINCT FROM c.source GROUP BY doc_id),
        f AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
                     length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
                     coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0) AS gone
              FROM d LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND n_words - gone >= 0.5 * n_words AS kept FROM b""",
    "op6_toolcalls": """
        WITH m AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS nw FROM conversations),
        c AS (SELECT conv_id, turn, text, nw FROM m WHERE role = 'user'),
        a AS (SELECT conv_id, turn, text FROM m WHERE role = 'assistant'),
        i AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM c),
        k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, chain ORDER BY turn) - 1 AS depth FROM i)
        SELECT k.conv_id || ':' || k.turn AS call_id, k.turn AS position, a.turn AS result_position, depth,
               CASE WHEN a.turn IS NULL THEN 'no_result' ELSE 'linked' END AS status,
               '{"arguments":{"n_words":' || nw || ',"query":' || to_json(k.text)::VARCHAR || '},"call_id":' || to_json(k.conv_id || ':' || k.turn)::VARCHAR
                 || CASE WHEN a.text IS NULL THEN '' ELSE ',"result":' || to_json(a.text)::VARCHAR END || ',"tool":"respond"}' AS event
        FROM k LEFT JOIN a ON a.conv_id = k.conv_id AND a.turn = k.turn + 1
        UNION ALL
        SELECT a.conv_id || ':' || (a.turn - 1), NULL, a.turn, 0, 'orphan_result',
               '{"call_id":' || to_json(a.conv_id || ':' || (a.turn - 1))::VARCHAR || ',"result":' || to_json(a.text)::VARCHAR || '}' FROM a
        WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = a.conv_id AND c.turn = a.turn - 1)
        UNION ALL
        SELECT conv_id || ':' || turn, turn, NULL, 0, 'other_turn', '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}'
        FROM m WHERE role NOT IN ('user', 'assistant')""",
    "op8_exactdedup": """
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op10_mixing": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                   ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS draw FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS lim FROM s),
        l AS (SELECT *, lim / weight AS level, sum(source_size) OVER () AS total FROM w),
        c AS (SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM l),
        f AS (SELECT min({'level': level, 'share': share}) AS found FROM c WHERE level > share),
        t AS (SELECT source, source_size, CASE WHEN found IS NULL OR level < found.level THEN lim::DOUBLE ELSE weight * found.share END AS target FROM c, f),
        r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        u AS (SELECT r.*, k, (draw + k * 140737488355328) % 4503599627370496 / 4503599627370496.0::DOUBLE < rate - floor(rate) AS again FROM r, range(0, 32) AS x(k)),
        e AS (SELECT source, k, abs(floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN again THEN size ELSE 0 END)::BIGINT - any_value(target)) AS off FROM u GROUP BY source, k),
        b AS (SELECT source, min({'off': off, 'k': k}).k AS k FROM e GROUP BY source)
        SELECT doc_id, size, source_size, target, ((floor(rate) + again::INTEGER)::BIGINT * size)::BIGINT AS taken
        FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source AND u.k = b.k""",
}
