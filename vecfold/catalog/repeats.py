"""Repeated substrings of whole texts."""

from __future__ import annotations

from vecfold.catalog.registry import Tables, query
from vecfold.operators import repeats as X
from vecfold.operators import suffixes as Y


def bounded_sql(table: str, key: str, text: str, low: int, high: int) -> str:
    return f"""
    WITH spots AS (SELECT {key}, {text} AS s, unnest(range(1, length({text}) + 1)) AS p FROM {table}),
    pieces AS (
      SELECT {key}, substring(s, p, n) AS repeat, substring(s, p + n, 1) AS nxt
      FROM spots, (SELECT unnest(range({low}, {high} + 1)) AS n) WHERE p + n - 1 <= length(s)
    )
    SELECT {key}, repeat, count(*) AS freq FROM pieces GROUP BY ALL
    HAVING count(*) >= 2 AND min(nxt) <> max(nxt)
    """


@query(bounded_sql("conversations", "conv_id * 100000 + turn", "text", 0, 4).replace(
    "conv_id * 100000 + turn", "key").replace("FROM conversations", "FROM (SELECT *, conv_id * 100000 + turn AS key FROM conversations)"))
def repeats_bounded(t: Tables):
    keyed = t.conversations.selectExpr("conv_id * 100000 + turn AS key", "text")
    return X.repeats(keyed, "key", "text", 0, 4)


@query("""
WITH spots AS (SELECT doc_id, text AS s, unnest(range(1, length(text) - 30)) AS p FROM documents),
pieces AS (SELECT doc_id, substring(s, p, 32) AS repeat, substring(s, p + 32, 1) AS nxt FROM spots)
SELECT repeat, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM pieces GROUP BY repeat
HAVING count(DISTINCT doc_id) >= 2 AND min(nxt) <> max(nxt)
""")
def repeats_corpus(t: Tables):
    """Passages of 32 characters that several whole documents hold and that go on in more than one way."""
    return X.corpus_repeats(t.documents, "doc_id", "text", 32, 32)


@query("""
WITH spots AS (SELECT doc_id, text AS s, unnest(range(1, length(text) - 30)) AS p FROM documents),
pieces AS (SELECT doc_id, substring(s, p, 32) AS repeat, substring(s, p + 32, 1) AS nxt FROM spots)
SELECT repeat, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM pieces GROUP BY repeat
HAVING count(DISTINCT doc_id) >= 2
   AND (min(nxt) <> max(nxt) OR count(DISTINCT doc_id) FILTER (WHERE nxt = '') >= 2)
""")
def repeats_corpus_ends(t: Tables):
    """``repeats_corpus`` where each document end is its own continuation, so shared endings are repeats too."""
    return X.corpus_repeats(t.documents, "doc_id", "text", 32, 32, own_ends=True)


def unbounded_sql(table: str, key: str, text: str) -> str:
    return f"""
    WITH spots AS (SELECT {key}, {text} AS s, unnest(range(1, length({text}) + 1)) AS p FROM {table}),
    pieces AS (
      SELECT {key}, substring(s, p, n) AS repeat, substring(s, p + n, 1) AS nxt
      FROM (SELECT *, unnest(range(0, length(s) - p + 2)) AS n FROM spots)
    )
    SELECT {key}, repeat, count(*) AS freq FROM pieces GROUP BY ALL
    HAVING count(*) >= 2 AND min(nxt) <> max(nxt)
    """


def rank_sql(table: str, key: str, text: str) -> str:
    return f"""
    spots AS (SELECT {key}, {text} AS s, unnest(range(1, length({text}) + 1)) AS p FROM {table}),
    tails AS (SELECT {key}, p AS pos, substring(s, p) AS tail FROM spots),
    ranked AS (SELECT {key}, pos, tail, row_number() OVER (PARTITION BY {key} ORDER BY encode(tail)) - 1 AS rank FROM tails)"""


@query(unbounded_sql("benchmark", "item_id", "text"))
def repeats_all(t: Tables):
    return Y.repeats_with_text(t.benchmark, "item_id", "text")


@query(f"SELECT page_id, count(*) AS nodes FROM ({unbounded_sql('pages', 'page_id', 'url')}) GROUP BY page_id")
def repeat_counts(t: Tables):
    return Y.repeat_counts(t.pages, "page_id", "url")


@query(f"WITH {rank_sql('benchmark', 'item_id', 'text')} SELECT item_id, pos, rank FROM ranked")
def suffix_rank(t: Tables):
    return Y.suffix_rank(t.benchmark, "item_id", "text")


@query(f"""
WITH {rank_sql('benchmark', 'item_id', 'text')},
pairs AS (SELECT item_id, pos, tail, lag(tail) OVER (PARTITION BY item_id ORDER BY rank) AS prev FROM ranked),
lens AS (SELECT item_id, pos, coalesce(list_max(list_filter(range(0, length(tail) + 1),
           lambda n: n <= length(prev) AND substring(tail, 1, n) = substring(prev, 1, n))), 0) AS lcp FROM pairs)
SELECT item_id, pos, lcp FROM lens
""")
def adjacent_prefixes(t: Tables):
    return Y.adjacent_prefixes(t.benchmark, "item_id", "text")


@query()
def repeat_counts_documents(t: Tables):
    """Number of repeats of every whole document."""
    return Y.repeat_counts(t.documents, "doc_id", "text")
