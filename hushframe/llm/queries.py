"""The queries of this folder by name, and the SQL that gives the same rows where there is one."""

from hushframe.llm.embedding_dedup import op10_embedding_near_dedup
from hushframe.llm.html_text import op9_html_extraction
from hushframe.llm.media_columns import op3_media_columns
from hushframe.llm.mixing import op5_mixing_sources
from hushframe.llm.ngram_join import op7_ngram_jaccard_join
from hushframe.llm.quality import op2_quality_classifier
from hushframe.llm.sentence_pieces import op1_sentence_pieces
from hushframe.llm.shared_spans import WINDOW
from hushframe.llm.substring_dedup import LEAST_WORDS, op4_substring_dedup
from hushframe.llm.token_counts import op8_token_counts
from hushframe.llm.url_filters import op6_url_filters

QUERIES = {f.__name__: f for f in (op1_sentence_pieces, op2_quality_classifier, op3_media_columns, op4_substring_dedup, op5_mixing_sources, op6_url_filters, op7_ngram_jaccard_join, op8_token_counts, op9_html_extraction, op10_embedding_near_dedup)}


def _sets(source: str, k: int, least: int = 1) -> str:
    """w(key, words), s(key, shingle) and n(key, n) of source, which selects key and text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""w AS (SELECT * FROM (SELECT key, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'),
lambda x: x <> '') words FROM ({source})) WHERE len(words) >= {least}),
s AS (SELECT DISTINCT key, unnest(CASE WHEN len(words) < {k} THEN [array_to_string(words, ' ')]
ELSE list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i + {k - 1}], ' ')) END) g FROM w WHERE len(words) > 0),
n AS (SELECT key, count(*) n FROM s GROUP BY key)"""


#: e(x, y) and reach(d, r): links both ways, and what they lead to.
_REACH = """e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(d, r) AS (SELECT x, y FROM e UNION SELECT d, y FROM reach JOIN e ON r = x),
c AS (SELECT d, least(d, min(r)) root FROM reach GROUP BY d)"""


def _links(percent: int) -> str:
    return f"""p AS (SELECT a.key x, b.key y, count(*) o FROM s a JOIN s b ON a.g = b.g AND a.key < b.key GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.key = x JOIN n ny ON ny.key = y WHERE 100 * o >= {percent} * (nx.n + ny.n - o))"""


#: Lines as units: their key is doc_id * 1000000 and the line's number.
_LINES = """SELECT doc_id * 1000000 + k - 1 AS key, lines[k] AS text
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) k FROM (SELECT doc_id, string_split(text, chr(10)) lines FROM documents WHERE text IS NOT NULL))"""
#: Places of lines in words, of all lines; and runs of windows that stand in an earlier document too.
_PLACES = """f AS (SELECT key, m, (sum(m) OVER (PARTITION BY key // 1000000 ORDER BY key) - m)::INT AS first
FROM (SELECT key, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::INT m FROM lines))"""
_RUNS = f"""dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') words FROM documents),
p51 AS (SELECT doc_id, pos, array_to_string(words[pos + 1:pos + {WINDOW}], ' ') g FROM (SELECT doc_id, words, unnest(range(0, len(words) - {WINDOW - 1})) AS pos FROM dw WHERE len(words) >= {WINDOW})),
k51 AS (SELECT doc_id, pos, first(doc_id) OVER o kd, first(pos) OVER o ka FROM p51 WINDOW o AS (PARTITION BY g ORDER BY doc_id, pos)),
r51 AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY pos) run
FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {WINDOW} THEN 0 ELSE 1 END gap FROM k51 WHERE doc_id <> kd))"""

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": f"""WITH RECURSIVE lines AS ({_LINES}), {_sets("FROM lines", 5, LEAST_WORDS)}, {_links(80)}, {_REACH}, {_PLACES}, {_RUNS}
SELECT d // 1000000 doc_id, a.first first_word, a.m n_words, root // 1000000 kept_doc_id, b.first kept_word, 'line' AS kind FROM c JOIN f a ON a.key = d JOIN f b ON b.key = root WHERE root <> d
UNION ALL SELECT doc_id, min(pos)::INT, (max(pos) + {WINDOW} - min(pos))::INT, arg_min(kd, pos), arg_min(ka, pos)::INT, 'run' FROM r51 GROUP BY doc_id, run""",
    "op7_ngram_jaccard_join": f"""WITH RECURSIVE {_sets("SELECT doc_id AS key, text FROM documents", 3)}, {_links(90)}, {_REACH},
m AS (SELECT x, count(*) n_links FROM e GROUP BY x)
SELECT doc_id, coalesce(n, 0) n_shingles, coalesce(n_links, 0) n_links, coalesce(root, doc_id) component_id FROM documents LEFT JOIN n ON key = doc_id LEFT JOIN m ON x = doc_id LEFT JOIN c ON d = doc_id""",
    "op10_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings),
l AS (SELECT a.vec_id x, b.vec_id y FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95), {_REACH},
m AS (SELECT x, count(*) n FROM e GROUP BY x)
SELECT vec_id, coalesce(n, 0) n_links, coalesce(root, vec_id) component_id, coalesce(root, vec_id) = vec_id AS kept FROM v LEFT JOIN m ON x = vec_id LEFT JOIN c ON d = vec_id""",
}
