import zlib
from collections import Counter

from loomvault.llm import sharding as S


def test_rows_law_and_facts(docs, rows, empty):
    got = S.assign(docs, 7).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(7))
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    facts = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert facts == Counter((x["doc_id"], len((x["text"] or "").encode()) + 1, zlib.crc32((x["text"] or "").encode())) for x in rows)
    assert S.assign(empty, 7).count() == 0


def test_one_more_shard_moves_little(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    a = {r["doc_id"]: r["shard"] for r in S.assign(df, 16).collect()}
    b = {r["doc_id"]: r["shard"] for r in S.assign(df, 17).collect()}
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert 1 / 17 <= moved < 0.2
    assert max(Counter(b.values()).values()) - min(Counter(b.values()).values()) <= 1


def test_walk_keeps_own_arcs_first():
    nodes = [(10, 0), (20, 1), (30, 0), (40, 1)]
    placed = S.walk([(0, 0, 5), (1, 1, 1), (2, 2, 1), (3, 3, 1)], nodes, [4, 4])
    got = sorted(placed)
    assert got[0] == (0, 0, 4, 0, 0) and (0, 4, 5, 1, 2) in got
    assert sum(hi - lo for _, lo, hi, _, _ in got) == 8


def test_equal_ids_in_great_number(spark):
    df = spark.range(900).selectExpr("7 AS doc_id", "'same' AS text").union(spark.range(100).selectExpr("cast(null AS int)", "cast(id AS string)"))
    counts = Counter(r["shard"] for r in S.assign(df, 3).collect())
    assert sorted(counts.values()) == [333, 333, 334]


def test_large_pieces_are_cut(spark, docs, rows, monkeypatch):
    df = spark.range(500).selectExpr("7 AS doc_id", "'same' AS text").union(spark.range(200).selectExpr("cast(null AS int)", "'x'"))
    monkeypatch.setattr(S, "PIECE", 30)
    got = S.assign(df, 3).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [233, 233, 234]
    assert len({(r["shard"], r["slot"]) for r in got}) == 700


def test_splits_of_the_files_change_nothing(spark, monkeypatch):
    df = spark.range(300).selectExpr("id % 40 AS doc_id", "cast(id % 90 AS string) AS text").union(spark.range(200).selectExpr("7 AS doc_id", "'same'"))
    monkeypatch.setattr(S, "PIECE", 10)
    got = [Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in S.assign(df.repartition(n), 5).collect()) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 500


def test_rows_go_where_a_walk_row_by_row_puts_them(spark):
    """Brute force: each document to the shard of the next node clockwise; overflow of full shards, node by node, to the next with room."""
    n, shards, vnodes = 400, 5, 8
    df = spark.range(n).selectExpr("id AS doc_id", "'t' AS text")
    point = {r["doc_id"]: r["p"] for r in df.selectExpr("doc_id", "xxhash64(doc_id) AS p").collect()}
    nodes = S.ring(shards, vnodes)
    room, where, over = S.quotas(n, shards), {}, {}
    for doc in sorted(point, key=lambda d: point[d]):
        k = next((i for i, (p, _) in enumerate(nodes) if p >= point[doc]), 0)
        over.setdefault(k, []).append(doc)
    waiting = {}
    for k in sorted(over):  # own arcs first
        mine = sorted(over[k], key=lambda d: point[d] if point[d] <= nodes[k][0] else point[d] - 2**64)
        take = min(len(mine), room[nodes[k][1]])
        room[nodes[k][1]] -= take
        where.update({d: nodes[k][1] for d in mine[:take]})
        waiting[k] = mine[take:]
    queue = []
    for step in range(2 * len(nodes)):
        k = step % len(nodes)
        while queue and room[nodes[k][1]]:
            where[queue.pop(0)] = nodes[k][1]
            room[nodes[k][1]] -= 1
        if step < len(nodes):
            queue += waiting.get(k, [])
    got = {r["doc_id"]: r["shard"] for r in S.assign(df, shards, vnodes).collect()}
    assert Counter(got.values()) == Counter(where.values())
    assert sum(got[d] != where[d] for d in where) <= 0.02 * n  # the arc that wraps around may be filled from either end
