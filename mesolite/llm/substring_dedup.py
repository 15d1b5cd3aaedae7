"""Operator 10: substring dedup by paragraph MinHash banding.

Two kinds of paragraphs of a document are compared:

* lines of at least ``LINE`` words, as sets of five-word shingles; each has
  ``BANDS`` MinHash bands of ``ROWS`` rows, so a pair of Jaccard similarity 0.75
  meets in some band with probability 1 - (1 - 0.75 ** ROWS) ** BANDS (0.987,
  0.9996 at 0.85), one of 0.3 with 0.2.  Lines that collide are verified by exact Jaccard similarity.
  Similar lines also share one of their rarest shingles, at most a quarter of each, so collisions
  are looked for in the lists of those, and a band's unlike lines are not compared with one another;
* passages between anchors, words whose hash is the least among ``REACH`` words
  to either side.  Anchors depend on the words near them only, so a passage
  that is copied into the middle of other text is cut alike there.  Passages
  have one band, the hash of all their words, which is exact; where a passage
  repeats, the match is extended word by word into the text around it, up to
  ``AROUND`` words to either side.

Linked paragraphs form components.  A component's first occurrence stays, the
others are removed where they lie in another document; touching removals of a
document are joined, and those of fewer than ``LEAST`` words are left alone,
which are set phrases, not passages.

A first pass over the texts counts band keys, with partial sums; keys of one
document drop out through a filter sized by the keys that are left before the
second pass, so only paragraphs that may repeat are shuffled.

Defined cases: null or empty text has no paragraphs; a text of any length is
cut into paragraphs as a whole; rows without an id are left alone; repeated
rows (one id) are one document; of equal paragraphs the one with the smallest
id stays; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesolite.llm import _words as W
from mesolite.llm._fold import emit_chunks, fold_fixed
from mesolite.llm._spark import counted, documents, written
from mesolite.llm.jaccard_join import id_filter, link_components, maybe_in, shared_postings, verify

LEAST = 51
LINE = 15
BANDS, ROWS = 8, 3
REACH = 4
AROUND = 20
SHINGLE, PERCENT = 5, 75
SKETCH_BITS = 20
_U = np.uint64
_NONE = np.uint16(0xFFFF)


def paragraphs(column: pa.Array) -> dict[str, np.ndarray]:
    """Lines and passages of the rows of a batch: row, first and last word (of the row), keys, the lines' shingles and short hashes of all words."""
    raw, offsets = W.utf8_buffer(column)
    raw = W.FOLD[raw]
    starts, ends, first = W.split_words(raw, offsets)
    n = len(starts)
    words = W.hash_spans(raw, starts, ends)
    row = W.row_of(first, n)
    begins = np.zeros(n + 1, bool)
    begins[first[first < n]] = True
    begins[n] = True
    # lines
    breaks = np.cumsum(raw == 10)
    at = breaks[starts] if n else np.zeros(0, np.int64)
    new = begins[:n].copy()
    new[1:] |= at[1:] != at[:-1]
    line = np.append(np.flatnonzero(new), n)
    long = np.flatnonzero(np.diff(line) >= LINE)
    line_row, shingles = W.shingle_hashes(words, line, SHINGLE)
    bounds = np.searchsorted(line_row, np.arange(len(line)))
    keys = np.zeros((len(line) - 1, BANDS), _U)
    for b in range(BANDS if len(shingles) else 0):
        for r in range(ROWS):
            least = np.minimum.reduceat(W.mix(shingles ^ W.mix(np.array([b * ROWS + r + 1], _U))), bounds[:-1])
            keys[:, b] = W.mix(keys[:, b] + W.mix(least ^ _U(b)))
    # passages
    pair = words.copy()
    if n > 1:
        pair[:-1] = W.mix(words[:-1] + W.mix(words[1:]))
    place = np.arange(n)
    inner = (place - REACH >= first[row]) & (place + REACH < first[row + 1]) if n else np.zeros(0, bool)
    cand = np.flatnonzero(inner)
    low = np.ones(len(cand), bool)
    for k in range(1, REACH + 1):
        low &= (pair[cand] < pair[cand - k]) & (pair[cand] <= pair[cand + k])
    cut = begins[:n].copy()
    cut[cand[low]] = True
    anchor = np.flatnonzero(cut)
    if n:  # runs of equal words have no anchor: they are cut at fixed places after the last one
        since = place - np.repeat(anchor, np.diff(np.append(anchor, n)))
        cut |= (since > 0) & (since % (16 * REACH) == 0)
    cuts = np.append(np.flatnonzero(cut), n)
    if n:
        inside = place - np.repeat(cuts[:-1], np.diff(cuts))
        digest = np.add.reduceat(W.mix(words + inside.astype(_U) * _U(0x9E3779B97F4A7C15)), cuts[:-1])
        digest = W.mix(digest + np.diff(cuts).astype(_U))
    else:
        digest = np.zeros(0, _U)
    enough = np.flatnonzero(np.diff(cuts) > REACH)
    return {
        "words": words,
        "first": first,
        "row": row,
        "line_at": line[:-1][long],
        "line_n": np.diff(line)[long],
        "line_keys": keys[long],
        "line_bounds": np.stack([bounds[:-1], bounds[1:]], 1)[long] if len(long) else np.zeros((0, 2), np.int64),
        "shingles": shingles,
        "cut_at": cuts[:-1][enough],
        "cut_n": np.diff(cuts)[enough],
        "cut_key": digest[enough],
    }


def shared_keys(docs: DataFrame) -> DataFrame:
    """The band keys that more than one document's paragraphs hold."""

    def run(batches):
        for batch in W.pieces(batches, 1):
            p = paragraphs(batch.column(1))
            rows = p["row"][np.concatenate([np.repeat(p["line_at"], BANDS), p["cut_at"]])]
            key = np.concatenate([p["line_keys"].ravel(), p["cut_key"]])
            order = np.lexsort((rows, key))  # the keys of this batch, once for each document
            key, rows = key[order], rows[order]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(key)) - 1
            more = rows[heads] != rows[tails] if len(heads) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(key[heads].view(np.int64)), pa.array(np.where(more, 2, 1).astype(np.int8))], names=["key", "n"])

    return docs.mapInArrow(run, "key long, n byte").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")


def _around(p: dict[str, np.ndarray], at: np.ndarray, step: int) -> pa.Array:
    """Short hashes of the ``AROUND`` words from ``at`` on in a direction, nearest first, as fixed bytes; ``_NONE`` beyond the text."""
    short = (p["words"] >> _U(48)).astype(np.uint16)
    short[short == _NONE] = 0
    row = p["row"][at - (step > 0)]
    place = at[:, None] + (np.arange(AROUND) if step > 0 else -1 - np.arange(AROUND))
    ok = (place >= p["first"][row][:, None]) & (place < p["first"][row + 1][:, None])
    got = np.where(ok, short[np.clip(place, 0, len(short) - 1)], _NONE) if len(short) else np.zeros((0, AROUND), np.uint16)
    return pa.Array.from_buffers(pa.binary(), len(got), [None, pa.py_buffer((np.arange(len(got) + 1) * 2 * AROUND).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(got).tobytes())])


def _line_ids(doc: np.ndarray, s: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(doc.view(_U)) + s.astype(_U) + W.mix(digest))


def _digests(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    sets = [np.unique(shingles[a:b]) for a, b in bounds]
    return np.array([W.mix(x).sum(dtype=_U) + _U(len(x)) for x in sets], _U), sets


def repeated_paragraphs(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """(u, doc_id, s, n, line, size, d, keys, left, right) of the paragraphs that hold a key of the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        seen = shared.value
        for batch in W.pieces(batches, 1):
            p = paragraphs(batch.column(1))
            ids = batch.column(0).to_numpy().astype(np.int64)
            lk = maybe_in(p["line_keys"].ravel().view(np.int64), seen).reshape(-1, BANDS)
            some = np.flatnonzero(lk.any(axis=1))
            ck = np.flatnonzero(maybe_in(p["cut_key"].view(np.int64), seen))
            at = np.concatenate([p["line_at"][some], p["cut_at"][ck]]).astype(np.int64)
            n = np.concatenate([p["line_n"][some], p["cut_n"][ck]]).astype(np.int64)
            row = p["row"][at]
            doc, s = ids[row] if len(row) else np.zeros(0, np.int64), at - p["first"][row]
            digest, sets = _digests(p["shingles"], p["line_bounds"][some])
            k = len(some)
            u = np.concatenate([_line_ids(doc[:k], s[:k], digest), np.zeros(len(ck), _U)])
            held = [p["line_keys"][i][lk[i]].view(np.int64) for i in some] + [p["cut_key"][i : i + 1].view(np.int64) for i in ck]
            none = pa.nulls(k, pa.binary())
            cut_at, cut_n = p["cut_at"][ck], p["cut_n"][ck]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(u.view(np.int64)),
                    pa.array(doc),
                    pa.array(s),
                    pa.array(n),
                    pa.array(np.arange(len(at)) < k),
                    pa.array([len(x) for x in sets] + [0] * len(ck), pa.int32()),
                    pa.array(np.concatenate([digest, np.zeros(len(ck), _U)]).view(np.int64)),
                    pa.array(held, pa.list_(pa.int64())),
                    pa.concat_arrays([none, _around(p, cut_at, -1)]),
                    pa.concat_arrays([none, _around(p, cut_at + cut_n, 1)]),
                ],
                names=["u", "doc_id", "s", "n", "line", "size", "d", "keys", "left", "right"],
            )

    return docs.mapInArrow(run, "u long, doc_id long, s long, n long, line boolean, size int, d long, keys array<long>, left binary, right binary")


def _held(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], np.repeat(np.arange(len(column)), np.diff(offsets))


def colliding(classes: DataFrame) -> DataFrame:
    """The rows of ``classes`` (id, keys, ...) with a band key that another one's have as well, and a few more."""
    keys = classes.select("id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y"))
    shared = classes.sparkSession.sparkContext.broadcast(id_filter(*counted(keys.filter("x != y").select("key"), "bands")))

    def run(batches):
        for batch in batches:
            keys, row = _held(batch.column("keys"))
            yield batch.filter(pa.array(np.bincount(row[maybe_in(keys, shared.value)], minlength=batch.num_rows) > 0))

    return classes.mapInArrow(run, classes.schema)


def line_sets(docs: DataFrame, wanted: DataFrame, held: int) -> DataFrame:
    """(id, own): the shingle sets of (at least) the ``held`` lines ``wanted`` (u, doc_id), by digest, read again from their documents."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((id_filter(wanted.select("doc_id"), held), id_filter(wanted.select("u"), held)))

    def run(batches):
        of_docs, of_lines = shared.value
        for batch in batches:
            some = batch.filter(pa.array(maybe_in(batch.column(0).to_numpy().astype(np.int64), of_docs)))
            for piece in W.pieces([some], 1):
                p = paragraphs(piece.column(1))
                row = p["row"][p["line_at"]]
                ids = piece.column(0).to_numpy().astype(np.int64)
                digest, sets = _digests(p["shingles"], p["line_bounds"])
                u = _line_ids(ids[row] if len(row) else np.zeros(0, np.int64), p["line_at"] - p["first"][row], digest).view(np.int64)
                keep = np.flatnonzero(maybe_in(u, of_lines))
                yield pa.RecordBatch.from_arrays([pa.array(digest[keep].view(np.int64)), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], names=["id", "own"])

    return docs.mapInArrow(run, "id long, own array<long>").groupBy("id").agg(F.first("own").alias("own"))


def rarest(sets: DataFrame) -> DataFrame:
    """(id, n, head): the size of each set and its shingles of which a set of the similarity has one at least, rarest among all sets first.

    Any order that all sets keep gives the same links; this one, by hashed
    counters of fixed size, gives short lists.
    """

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            at, n = np.unique(_held(batch.column(0))[0].view(_U) >> _U(64 - SKETCH_BITS), return_counts=True)
            total[at.astype(np.int64)] += n.astype(np.int32)
        yield emit_chunks(total)

    shared = sets.sparkSession.sparkContext.broadcast(fold_fixed(sets.select("own"), count, "<i4", np.add))

    def run(batches):
        for batch in batches:
            flat, row = _held(batch.column("own"))
            rare = shared.value[(flat.view(_U) >> _U(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((flat, rare, row))
            n = np.bincount(row, minlength=batch.num_rows)
            most = n + -PERCENT * n // 100 + 1  # one more than may lie outside of a set that is similar
            first = np.cumsum(n) - n
            head = flat[order[np.arange(len(flat)) - first[row] < most[row]]]
            ends = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(head))], names=["id", "n", "head"])

    return sets.select("id", "own").mapInArrow(run, "id long, n int, head array<long>")


def extended(found: DataFrame) -> DataFrame:
    """(doc_id, s, n, keep) with the words around a passage that the kept copy has as well."""

    def run(batches):
        for batch in batches:
            n, s = batch.column("n").to_numpy().copy(), batch.column("s").to_numpy().copy()
            for own, kept, moves in (("left", "kleft", True), ("right", "kright", False)):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, AROUND) for c in (own, kept))
                same = np.logical_and.accumulate((x == y) & (x != _NONE), axis=1).sum(axis=1)
                n += same
                if moves:
                    s -= same
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(n), batch.column("keep")], names=["doc_id", "s", "n", "keep"])

    return found.mapInArrow(run, "doc_id long, s long, n long, keep long")


def line_components(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(node, component) of the ``classes`` (id, doc_id, u, keys) of lines that share a band key and are similar; None if none are.

    The lists that are joined are of shingles, not of bands: two sets of the
    similarity have one of their rarest shingles in common, so each link is met
    in such a list, and is taken if the two share a band key as well.
    """
    some, n = counted(colliding(classes), "colliding")
    if not n:
        return None
    sets = written(line_sets(docs, some, n), "sets")
    postings, n = shared_postings(written(rarest(sets), "rarest"))
    bands = some.select("id", "keys")

    def check(pairs: DataFrame) -> DataFrame:
        side = lambda c: bands.select(F.col("id").alias(c), F.col("keys").alias(f"keys{c}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.arrays_overlap("keysa", "keysb"))
        return verify(met.select("a", "b"), sets, PERCENT)

    return link_components(postings, n, check, PERCENT)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, keep_doc_id): word spans to remove and the first document that keeps their text."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    units = written(repeated_paragraphs(rows, id_filter(*counted(shared_keys(rows), "keys"))), "paragraphs")

    # passages: one key, exact
    cuts = units.filter(~F.col("line")).select(F.col("keys")[0].alias("key"), "doc_id", "s", "n", "left", "right")
    firsts = cuts.groupBy("key").agg(F.min(F.struct("doc_id", "s", "left", "right")).alias("k"), F.max("doc_id").alias("last")).filter(F.col("k.doc_id") != F.col("last"))
    firsts = written(firsts.select("key", F.col("k.doc_id").alias("keep"), F.col("k.left").alias("kleft"), F.col("k.right").alias("kright")), "firsts")
    passages = extended(cuts.join(firsts, "key").filter("doc_id != keep"))

    # lines: classes of equal sets, collisions of classes, exact similarity, components
    lines = units.filter("line").groupBy("u").agg(*(F.first(c).alias(c) for c in ("doc_id", "s", "n", "d", "keys")))
    lines = written(lines.withColumnRenamed("d", "id"), "lines")
    classes = lines.groupBy("id").agg(F.min(F.struct("doc_id", "u")).alias("k"), F.max("doc_id").alias("last"), F.first("keys").alias("keys"))
    classes = written(classes.select("id", F.col("k.doc_id").alias("doc_id"), F.col("k.u").alias("u"), "last", "keys"), "classes")
    comps = line_components(rows, classes)
    classes = classes.select("id", F.col("doc_id").alias("keep"), "last")
    if comps is not None:
        classes = written(classes.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")), "named")
        keepers = written(classes.groupBy("c").agg(F.min("keep").alias("keep"), F.max("last").alias("last")).filter("keep != last"), "keepers")
        classes = classes.select("id", "c").join(keepers, "c")
    classes = written(classes.filter("keep != last").select("id", "keep"), "kept")
    alike = lines.select("id", "doc_id", "s", "n").join(classes, "id").filter("doc_id != keep").select("doc_id", "s", "n", "keep")

    spans = alike.unionByName(passages).groupBy("doc_id", "s", "n").agg(F.min("keep").alias("keep"))
    order = Window.partitionBy("doc_id").orderBy("s", "n")
    upto = F.max(F.col("s") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.when(F.col("s") <= upto, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy("doc_id", "island").agg(F.min("s").alias("start_word"), F.max(F.col("s") + F.col("n")).alias("end_word"), F.min("keep").alias("keep_doc_id"))
    out = out.withColumn("n_words", F.col("end_word") - F.col("start_word"))
    return out.filter(F.col("n_words") >= least).select("doc_id", "start_word", "end_word", "n_words", "keep_doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(documents(spark, sf_dir))
