"""Hard negatives, weighted clustering and virtual slots against plain versions of the same."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesolite.llm import hard_negatives, virtual_slots, weighted_clustering
from mesolite.llm._vectors import MOST
from tests.llm.conftest import EMBEDDINGS, edge_embeddings
from tests.oracle import SF_DIR


def rows_of(spark, sf_dir):
    return [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]


def sound(e):
    return e is not None and all(x is not None and np.isfinite(x) for x in e)


def grid(e, scale):
    return [int(np.floor(float(x) * scale)) for x in e]


def plain_negatives(rows):
    rows = [(i, grid(e, 256), (n + 1) % 10 if i % 7 == 0 else n) for i, e, n in rows if i is not None and n is not None and sound(e)]
    width = max((len(v) for _, v, _ in rows), default=0)
    x = np.array([v + [0] * (width - len(v)) for _, v, _ in rows], np.int64).reshape(len(rows), width)
    out = []
    for a, (i, _, n) in enumerate(rows):
        if i % 100 == 0:
            s = (x @ x[a]).tolist()
            order = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-s[b], rows[b][0]))
            for p in [b for b in order if rows[b][2] == n][:5]:
                window = [b for b in order if rows[b][2] != n and 80 * s[p] <= 100 * s[b] <= 100 * s[p]]
                out += [(i, rows[p][0], k + 1, rows[b][0], s[p], s[b]) for k, b in enumerate(window[:5])]
    return sorted(out)


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_hard_negatives(spark, edge_dir, where):
    sf = SF_DIR if where == "sf" else edge_dir
    want = plain_negatives(rows_of(spark, sf))
    assert want and sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, sf).collect())) == want


def test_hard_negatives_in_small_blocks(spark, edge_dir, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 20)
    assert sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, edge_dir).collect())) == plain_negatives(rows_of(spark, edge_dir))


@pytest.mark.parametrize("most", [40, 2**20, MOST])
def test_intervals_hold_every_score_and_rule_rows_out(most):
    rng = np.random.default_rng(1)
    x, a = rng.integers(-most, most, (400, 64)), rng.integers(-most, most, (7, 64))
    book = hard_negatives.codebook(x[:300])
    codes, norms = hard_negatives.encode(x, book)
    block = object.__new__(hard_negatives.Anchors)
    block.row, block.vector, block.book = np.arange(7), a, book
    block.prepare()
    low, high = block.interval(codes, norms)
    exact = x @ a.T
    assert (low <= exact).all() and (exact <= high).all()
    # the intervals are narrow against the spread of the scores
    assert np.median(high - low) < 1.5 * exact.std()


def plain_clusters(rows, rounds=3, k=16):
    kept = [(i, grid(e, 64)) for i, e, _ in rows if sound(e) and len(e) == 64]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    x = np.array([v for _, v in kept], np.int64)
    for r in range(rounds + 1):
        d = ((x[:, None] - np.array(c)[None]) ** 2).sum(2)
        best = d.argmin(1)
        if r < rounds:
            c = [[int(t) // int((best == j).sum()) for t in x[best == j].sum(0)] if (best == j).any() else v for j, v in enumerate(c)]
    d = d.min(1)
    return [(i, int(b), int(y), int(d[best == b].sum()), int(d.sum()), weighted_clustering.digest(c[b])) for (i, _), b, y in zip(kept, best, d, strict=True)]


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_clusters(spark, edge_dir, where):
    sf = SF_DIR if where == "sf" else edge_dir
    assert Counter(map(tuple, weighted_clustering.op12_weighted_clustering(spark, sf).collect())) == Counter(plain_clusters(rows_of(spark, sf)))


def test_rounds_run_over_distinct_vectors(spark, edge_dir):
    kept = weighted_clustering.keep(spark.read.parquet(f"{edge_dir}/embeddings.parquet"))
    distinct = weighted_clustering.distinct_vectors(kept)
    assert distinct.agg(F.sum("n")).first()[0] == kept.count() and distinct.count() == kept.select("vector").distinct().count() < kept.count() - 100


def test_few_and_huge_vectors(spark):
    rows = [dict(edge_embeddings()[0], vec_id=k, embedding=[s * 1e30] * 64) for k, s in enumerate((1, -1, 1))]
    df = spark.createDataFrame([(r["vec_id"], r["embedding"], 1) for r in rows], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in weighted_clustering.cluster(weighted_clustering.keep(df)).collect()}
    assert got[0].vector == [MOST] * 64 and got[0].cluster == got[2].cluster != got[1].cluster and got[0].inertia == 0
    assert hard_negatives.mine(hard_negatives.mislabelled(hard_negatives.eligible(df))).count() == 0
    assert EMBEDDINGS.field("embedding").type.value_type == "float"


def plain_shards(docs, slots=virtual_slots.SLOTS, parts=virtual_slots.PARTS, shards=8):
    rows = []
    for i, text in docs:
        data = (text or "").encode()
        size, crc = len(data) + 1, zlib.crc32(data)
        key = hashlib.md5(f"{'' if i is None else i}:{size}:{crc}".encode()).hexdigest()
        rows.append((i, size, crc, key, int(key[:8], 16) % slots, int(key[8:12], 16) % parts))
    loads = Counter()
    for r in rows:
        loads[r[4]] += r[1]
    home = {s: s * shards // slots for s in range(slots)}
    share = -(-sum(loads.values()) // shards)
    shard, moving, filled = dict(home), [], [0] * shards
    for h in range(shards):
        run = 0
        for s in sorted((s for s in range(slots) if home[s] == h), key=lambda s: (-loads[s], s)):
            run += loads[s] if loads[s] <= share else 0
            if loads[s] == 0 or loads[s] <= share and run <= share:
                filled[h] += loads[s]
            else:
                moving.append(s)
    for s in sorted(moving, key=lambda s: (-loads[s], s)):
        shard[s] = filled.index(min(filled))
        filled[shard[s]] += loads[s]
    place, out = Counter(), []
    for r in sorted(rows, key=lambda r: (r[4], r[5], r[3])):
        out.append((r[0], r[1], r[2], shard[r[4]], place[shard[r[4]]], r[4], home[r[4]]))
        place[shard[r[4]]] += 1
    return out, filled


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_shards(spark, edge_dir, where):
    sf = SF_DIR if where == "sf" else edge_dir
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, filled = plain_shards(docs)
    got = virtual_slots.op13_virtual_slots(spark, sf).select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot", "home_shard", "law", "grown_shard", "next_shard").collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter(want) and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert all(r.next_shard in (r.shard, 8) for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    if where == "sf":
        assert max(filled) - min(filled) < 0.01 * sum(filled)


def test_equal_ids_spread_and_edits_move_little(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 97 + 1).cast("int")).alias("text"), F.lit("x").alias("shard"), F.col("id").alias("slot"))
    docs = docs.withColumn("text", F.concat("text", F.col("slot").cast("string")))
    rows = virtual_slots.records(docs)
    loads = virtual_slots.slot_bytes(virtual_slots.part_counts(rows))
    one = virtual_slots.first_map(spark)
    two = virtual_slots.rebalanced(one, loads)
    three = virtual_slots.grown(two, loads)
    by = lambda m: [r[0] for r in m.join(loads, "slot").groupBy("shard").agg(F.sum("bytes")).orderBy("shard").select("sum(bytes)").collect()]
    total = loads.agg(F.sum("bytes")).first()[0]
    assert max(by(two)) - min(by(two)) < 0.001 * total and max(by(three)) - min(by(three)) < 0.02 * total and len(by(three)) == 9
    moved = lambda a, b: a.alias("a").join(b.alias("b"), "slot").filter("a.shard != b.shard")
    assert moved(one, two).count() < 0.2 * virtual_slots.SLOTS and moved(two, three).filter("b.shard != 8").count() == 0
    back = virtual_slots.rebalanced(three, loads, 8)  # without the ninth shard again
    assert back.filter("shard > 7").count() == 0 and max(by(back)) - min(by(back)) < 0.001 * total


def test_versions_are_stored_and_rows_written(spark, tmp_path, edge_dir):
    store, out = str(tmp_path / "map"), str(tmp_path / "shards")
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    loads = virtual_slots.slot_bytes(virtual_slots.part_counts(virtual_slots.records(docs)))
    virtual_slots.save_map(virtual_slots.first_map(spark), store)
    virtual_slots.save_map(virtual_slots.rebalanced(virtual_slots.load_map(spark, store), loads), store)
    newest = virtual_slots.load_map(spark, store)
    assert {r.version for r in newest.select("version").distinct().collect()} == {2} and newest.count() == virtual_slots.load_map(spark, store, 1).count() == virtual_slots.SLOTS
    virtual_slots.write_shards(docs, out, newest)
    back = spark.read.parquet(out)
    assert sorted(map(repr, back.select("doc.*").collect())) == sorted(map(repr, docs.collect()))
    want = {tuple(r) for r in virtual_slots.op13_virtual_slots(spark, edge_dir).select("size", "text_crc32", "shard", "slot").collect()}
    assert {tuple(r) for r in back.select("size", "text_crc32", "shard", "slot").collect()} == want
