"""DuckDB SQL that rebuilds the vault's tables in its own way, for comparison."""

from __future__ import annotations

from ..sources.projection import projection_sql

# The patterns of the note format.
_FM = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"
_H = r"(?m)^(#{1,6})\s+(.+?)(?:\s+#+)?$"
_WIKI = r"(!?)\[\[([^#|^\]\n]*)(?:#([^^|#\]\n]*))?(?:#?\^([^|\]\n]*))?(?:\|([^\]\n]*))?\]\]"
_MD = r"""(!?)\[([^\]]*)\]\(([^)\s]+)(?:\s+"([^"]*)")?\)"""

VAULT = f"vault AS ({projection_sql('varchar')}), "

PARSED = (
    VAULT
    + f"""parsed AS (SELECT doc_id, path, content, regexp_extract(content, '{_FM}', 1) AS fm, regexp_replace(content, '{_FM}', '') AS body FROM vault),
pieces AS (SELECT doc_id, path, fm, body, list_filter(string_split(regexp_replace(body, '{_H}', chr(1) || '\\0', 'g'), chr(1)), lambda c: trim(c, chr(10) || chr(13) || chr(9) || ' ') <> '') AS cs FROM parsed),
chunks AS (SELECT doc_id, path, fm, i - 1 AS ordinal, cs[i] AS chunk FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM pieces)),
heads AS (SELECT *, length(regexp_extract(split_part(chunk, chr(10), 1), '{_H}', 1)) AS level, regexp_extract(split_part(chunk, chr(10), 1), '{_H}', 2) AS htext FROM chunks),
above AS (SELECT a.path, a.ordinal, b.ordinal AS bo, b.htext FROM heads a JOIN heads b ON a.path = b.path AND b.ordinal < a.ordinal AND b.level > 0 AND a.level > 0 AND b.level < a.level
  WHERE NOT EXISTS (SELECT 1 FROM heads c WHERE c.path = a.path AND c.ordinal > b.ordinal AND c.ordinal < a.ordinal AND c.level > 0 AND c.level <= b.level)
    AND NOT EXISTS (SELECT 1 FROM heads c WHERE c.path = a.path AND c.ordinal > b.ordinal AND c.ordinal < a.ordinal AND c.level > 0 AND c.level < b.level)),
hp AS (SELECT h.path, h.ordinal, CASE WHEN h.level = 0 THEN [] ELSE list_append(coalesce((SELECT list(x.htext ORDER BY x.bo) FROM above x WHERE x.path = h.path AND x.ordinal = h.ordinal), []), h.htext) END AS heading_path FROM heads h),
fmtags AS (SELECT path, list_transform(regexp_extract_all(fm || chr(10), '  - (.*)\\n', 1), lambda t: trim(t)) AS ft FROM parsed),
secs AS (SELECT h.doc_id, h.path AS note_path, h.ordinal, h.level, h.htext, hp.heading_path, h.chunk AS content, CASE WHEN len(hp.heading_path) = 0 THEN h.path ELSE h.path || '#' || array_to_string(hp.heading_path, '/') END AS section_path,
  regexp_extract(h.path, '^(.*/)[^/]+$', 1) AS folder,
  list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace(h.chunk, '```[\\s\\S]*?```|``[^`]+``|`[^`]+`', '', 'g'), '\\[\\[[^\\]]+\\]\\]', '', 'g'), '#([\\p{{L}}\\p{{N}}\\p{{M}}_/-]+)', 1), lambda t: NOT regexp_full_match(t, '[0-9]+'))) AS inline_tags,
  f.ft AS fm_tags FROM heads h JOIN hp USING (path, ordinal) JOIN fmtags f ON f.path = h.path),
sections AS (SELECT * EXCLUDE (inline_tags), inline_tags, list_sort(list_distinct(list_concat(fm_tags, inline_tags))) AS tags FROM secs),
toks AS (SELECT note_path, section_path, tags, w FROM (SELECT note_path, section_path, tags, lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS w FROM (SELECT note_path, section_path, tags, unnest(string_split_regex(trim(content, chr(10) || ' '), '\\s+')) AS x FROM sections)) WHERE w <> ''),
lens AS (SELECT s.section_path, s.note_path, s.tags, count(t.w) AS dl FROM sections s LEFT JOIN toks t USING (section_path) GROUP BY ALL),
wiki AS (SELECT note_path, unnest(regexp_extract_all(content, '{_WIKI}', 1)) AS embed, unnest(regexp_extract_all(content, '{_WIKI}', 2)) AS target, unnest(regexp_extract_all(content, '{_WIKI}', 3)) AS heading, unnest(regexp_extract_all(content, '{_WIKI}', 5)) AS alias FROM sections),
md AS (SELECT note_path, unnest(regexp_extract_all(content, '{_MD}', 2)) AS txt, unnest(regexp_extract_all(content, '{_MD}', 3)) AS target, unnest(regexp_extract_all(content, '{_MD}', 4)) AS title FROM sections)"""
)


def with_vault(select: str, *more: str) -> str:
    """select over vault, sections, toks, lens, wiki and md, and further named queries."""
    return "WITH " + ", ".join([PARSED, *more]) + " " + select


def bm25_cte(terms: dict[str, int], where: str = "true") -> str:
    """score by section of the given query terms, with the statistics of the whole corpus."""
    values = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return (
        f"q(term, times) AS (VALUES {values}), cs AS (SELECT count(*) AS n, sum(dl) AS total FROM lens), "
        "tf AS (SELECT section_path, w AS term, count(*) AS tf FROM toks WHERE w IN (SELECT term FROM q) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
        "bm AS (SELECT l.section_path, l.note_path, sum(q.times * ln((cs.n - dfs.df + 0.5e0) / (dfs.df + 0.5e0) + 1e0) * tf.tf * 2.2e0 / (tf.tf + 1.2e0 * (0.25e0 + 0.75e0 * l.dl / (cs.total * 1e0 / cs.n)))) AS score "
        f"FROM tf JOIN q USING (term) JOIN dfs USING (term) JOIN lens l ON l.section_path = tf.section_path CROSS JOIN cs WHERE {where} GROUP BY ALL)"
    )


def jaccard_cte(grams: list[str], where: str = "true") -> str:
    """Similarity of tags and the query's n-grams, by section."""
    values = "[" + ", ".join(f"'{g}'" for g in grams) + "]"
    return (
        f"tg AS (SELECT section_path, note_path, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g FROM (SELECT section_path, note_path, '$$' || lower(array_to_string(ordered_tags, ' ')) || '$$' AS p, tags FROM tagged) WHERE {where} AND len(tags) > 0), "
        f"jc AS (SELECT section_path, note_path, len(list_intersect(g, {values})) * 1e0 / len(list_distinct(list_concat(g, {values}))) AS score FROM tg), jq AS (SELECT * FROM jc WHERE score > 0)"
    )


TAGGED = "tagged AS (SELECT *, list_concat(fm_tags, list_filter(list_sort(inline_tags), lambda t: NOT list_contains(fm_tags, t))) AS ordered_tags FROM sections)"
