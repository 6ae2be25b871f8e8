"""Accuracy of recognised texts against expected ones: each document against one benchmark item, and pages aligned by their number.

Words of both texts go through one tagged union: one exchange by (key, word)
with sums combined before it, and one by key. The number of benchmark items is a
scalar, so that documents meet theirs by an equal key.
"""

_PAIRS = """
    SELECT d.doc_id, b.item_id, d.text AS got, b.text AS want
    FROM (SELECT doc_id, text, doc_id % (SELECT count(*) FROM {benchmark}) AS k FROM {documents}) d JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS k FROM {benchmark}) b ON b.k = d.k"""


def word_sums(pairs: str, keys: str, tokens: str = "$TOKENS({})") -> str:
    """Counts of words (n), kinds (k) and what both texts have, for pairs of texts `got` and `want` under `keys`; null texts have none."""
    return f"""
    SELECT {keys}, CAST(sum(g) AS BIGINT) AS n_got, CAST(sum(w) AS BIGINT) AS n_want, count_if(g > 0) AS k_got, count_if(w > 0) AS k_want, CAST(sum(least(g, w)) AS BIGINT) AS inter, count_if(least(g, w) > 0) AS kinds
    FROM (SELECT {keys}, t, sum(g) AS g, sum(w) AS w FROM (
            SELECT {keys}, 0 AS g, 0 AS w, NULL AS t FROM ({pairs})
            UNION ALL SELECT {keys}, 1 AS g, 0 AS w, $EXPLODE({tokens.format("got")}) AS t FROM ({pairs})
            UNION ALL SELECT {keys}, 0 AS g, 1 AS w, $EXPLODE({tokens.format("want")}) AS t FROM ({pairs})) GROUP BY {keys}, t)
    GROUP BY {keys}"""


def _f1(both: str, got: str, want: str) -> str:
    """Two empty texts agree, one empty text doesn't."""
    return f"CASE WHEN {got} = 0 AND {want} = 0 THEN 1.0D WHEN {got} = 0 OR {want} = 0 THEN 0.0D ELSE round(2.0D * {both} / ({got} + {want}), 9) END"


_SUMS = word_sums(_PAIRS, "doc_id")

#: F1 of bags of words.
WORD_F1 = f"SELECT doc_id, n_got, n_want, inter, {_f1('inter', 'n_got', 'n_want')} AS f1 FROM ({_SUMS})"

#: F1 of sets of words.
SET_F1 = f"SELECT doc_id, {_f1('kinds', 'k_got', 'k_want')} AS f1 FROM ({_SUMS})"

#: Character error rate: edits over the length expected, on characters of the whole texts.
CER = f"""
    SELECT doc_id, CASE WHEN length(want) = 0 THEN CASE WHEN length(got) = 0 THEN 0.0D ELSE 1.0D END
      ELSE round(CAST($EDITS(got, want) AS DOUBLE) / length(want), 9) END AS cer FROM ({_PAIRS})"""

#: Share of expected characters that are anywhere in the text.
CHAR_PRESENCE = f"SELECT doc_id, round($PRESENT(want, got) * 1.0D / greatest(1, length(want)), 9) AS present FROM ({_PAIRS})"

_LETTERS = "SELECT doc_id, $LETTERS(want) AS want, $LETTERS(got) AS got FROM (" + _PAIRS + ")"

#: Share of the expected letters and digits, of any script, that the text has, each as often; texts that expect none are left out.
CHAR_BAG = f"SELECT doc_id, n_want AS expected, inter AS found FROM ({word_sums(_LETTERS, 'doc_id', '{}')}) WHERE n_want > 0"

#: Expected pages and what was recognised: by page number, else by index (from 0), else by place among the document's pages; a page that is missing is empty.
_ALIGNED = """
    SELECT e.doc, e.page, e.text AS want, a.text AS got, e.n_regions AS regions_want, coalesce(a.n_regions, 0) AS regions_got
    FROM {expected_pages} e LEFT JOIN (SELECT doc, coalesce(page, page_index + 1, row_number() OVER (PARTITION BY doc ORDER BY position)) AS number, text, n_regions FROM {actual_pages}) a
    ON a.doc = e.doc AND a.number = e.page"""

PAGE_SCORES = f"""
    SELECT s.doc, s.page, s.n_got, s.n_want, s.inter, {_f1('s.inter', 's.n_got', 's.n_want')} AS f1, a.regions_got, a.regions_want, round(a.regions_got * 1.0D / greatest(1, a.regions_want), 9) AS region_ratio
    FROM ({word_sums(_ALIGNED, "doc, page")}) s JOIN ({_ALIGNED}) a ON a.doc = s.doc AND a.page = s.page"""

#: Scores of a document: over the words of all its pages, and the mean of its pages.
DOCUMENT_SCORES = f"""
    SELECT doc, pages, inter, {_f1('inter', 'n_got', 'n_want')} AS f1, mean_f1 FROM (
      SELECT doc, count(*) AS pages, CAST(sum(inter) AS BIGINT) AS inter, CAST(sum(n_got) AS BIGINT) AS n_got, CAST(sum(n_want) AS BIGINT) AS n_want, round(sum(CAST(f1 AS DECIMAL(18, 9))) * 1.0D / count(*), 6) AS mean_f1
      FROM ({PAGE_SCORES}) GROUP BY doc)"""

QUERIES = {"char_bag": CHAR_BAG, "word_f1": WORD_F1, "set_f1": SET_F1, "cer": CER, "char_presence": CHAR_PRESENCE, "page_scores": PAGE_SCORES, "document_scores": DOCUMENT_SCORES}
