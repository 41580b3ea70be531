import importlib.util

import pytest

import __spark_entry__ as entry
from loomvault.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
    has = importlib.util.find_spec("loomvault.llm") is not None and importlib.util.find_spec("loomvault.llm.registry") is not None
    assert any(n.startswith("op7_") for n in entry.queries()) == has


def canon(rows, columns):
    order = sorted(columns)
    value = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", ["section_split", "all_tags", "path_parts", "bm25_filtered", "tag_jaccard", "rrf_hybrid", "notes_grouped", "render_hits", "tag_children", "dangling_links", "event_stream_upsert", "change_apply", "index_change", "corpus_after_change", "notes_indexed", "bm25_postings_topk", "upsert_conflicts", "heading_paths", "note_serialise", "section_resources", "folder_counts_below", "link_parse", "scorer_hits", "bm25_blockmax_topk", "bm25_many", "rrf_many", "tag_jaccard_postings", "tag_expand_range", "tag_tree", "levels_postings", "levels_blockmax_topk", "view_terms", "view_tags", "view_folders", "view_wikilinks", "commit_outcomes", "commit_state", "commit_changes", "rename_many_links", "merkle_diff"])
def test_queries_match_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), columns)
