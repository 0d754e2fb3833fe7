"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning, exact checks.

Two documents are linked if their sets of word shingles have a Jaccard similarity of at
least ``percent`` / 100. Texts with one set form a class, and only classes are compared.
Classes that share a band of their signatures are candidates. For a candidate pair,
batches of signature places are compared one after another; after each batch the pair is
dropped if, with a uniform prior on the similarity, the posterior probability that it
reaches the threshold is below ``miss``. What is left is checked on the full sets.

A bucket of n classes is not turned into n * n rows. First each member is compared with
one leader, the member that shares most buckets with others (in a group of edited
copies, that is the text most of them come from). Pairs inside one component need no
check. Where a bucket's components still differ, its pairs are compared: as rows if the
bucket is small; else inside tasks that each hold two blocks of bounded size and give
out no more links than connect their members. No pair that the bands propose is left out
except by the Bayesian test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.components import components
from talkloom.llm.stores import free_name, sent_if_small
from talkloom.llm.text import MinHash, WordHashes, lower_words, shingle_hashes, sparing, text_bytes
from talkloom.sources.scratch import written

PERCENT = 75
BANDS, ROWS = 32, 4
BATCH = 16
MISS = 1e-6
#: Buckets of more members than this are compared block by block.
SMALL_BUCKET = 48
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
#: A pair, a class or a decision takes 8 to 40 bytes; more rows than this are not broadcast.
MOST_SENT = 300_000


def needed_matches(places: int, percent: int, miss: float) -> int:
    """The fewest equal places out of ``places`` with which a pair goes on.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its mass above t is
    the probability of at most m successes in n + 1 trials of chance t.
    """
    t, mass = percent / 100, 0.0
    for equal in range(places + 1):
        mass += math.comb(places + 1, equal) * t**equal * (1 - t) ** (places + 1 - equal)
        if mass >= miss:
            return equal
    return places


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, permutations = WordHashes(), MinHash(BANDS * ROWS)
    for batch in batches:
        sizes, digests, signatures = [], [], []
        for text in text_bytes(batch.column("text")):
            own = np.unique(shingle_hashes(lower_words(text), hashes))
            sizes.append(len(own))
            digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            signatures.append(permutations.signature(own).tobytes() if len(own) else None)
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
            ["doc_id", "mark", "n_shingles", "digest", "signature"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of wanted classes; a row whose text is of another class than wanted is left out."""
    hashes = WordHashes()
    for batch in batches:
        classes, sets = [], []
        wanted = zip(batch.column("cls").to_pylist(), batch.column("digest").to_pylist(), strict=True)
        for (cls, digest), text in zip(wanted, text_bytes(batch.column("text")), strict=True):
            own = np.unique(shingle_hashes(lower_words(text), hashes))
            if xxhash.xxh3_128_digest(own.tobytes()) == digest:
                classes.append(cls)
                sets.append(own.tobytes())
        yield pa.record_batch([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["cls", "data"])


def _likely(percent: int, miss: float):
    steps = [(n, needed_matches(n, percent, miss)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
                for c in ("data_a", "data_b")
            )
            alive, equal, start = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for end, least in steps:
                equal = equal + (left[alive, start:end] == right[alive, start:end]).sum(axis=1)
                goes_on = equal >= least
                alive, equal, start = alive[goes_on], equal[goes_on], end
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return judge


def _exact(percent: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, before, first = [], None, None
            for k, (left, right) in enumerate(zip(batch.column("data_a"), batch.column("data_b"), strict=True)):
                if before is None or not left.equals(before):
                    before, first = left, np.frombuffer(left.as_py(), np.uint64)
                second = np.frombuffer(right.as_py(), np.uint64)
                common = len(np.intersect1d(first, second, assume_unique=True))
                if 100 * common >= percent * (len(first) + len(second) - common):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return judge


def _judged(pairs: DataFrame, payload: DataFrame, judge) -> DataFrame:
    """The pairs that ``judge`` keeps, given the payload (cls, data) of both sides.

    The side of a leader with many members is a skewed join key, which AQE splits.
    """
    few = sent_if_small(pairs, MOST_SENT)
    one = payload.select(F.col("cls").alias("b"), F.col("data").alias("data_b")).join(few, "b")
    both = payload.select(F.col("cls").alias("a"), F.col("data").alias("data_a")).join(one, "a")
    return both.select("a", "b", "data_a", "data_b").mapInArrow(judge, "a long, b long")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, n_shingles, digest, signature) of each row; the last two are null for an empty set.

    The mark is a hash of the text: with it a row is found again even if it shares its id, or has none.
    """
    return _marked(docs, doc_id, text).mapInArrow(sparing(_sets), "doc_id long, mark long, n_shingles long, digest binary, signature binary")


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    content = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(content).alias("mark"), content.alias("text"))


def _same_row(rows: DataFrame, wanted: DataFrame) -> Column:
    return rows["doc_id"].eqNullSafe(wanted["rep"]) & (rows["mark"] == wanted["rep_mark"])


def _once(rows: DataFrame, *columns: str) -> DataFrame:
    """(cls, columns) once for each class; only classes whose row is repeated are grouped."""
    repeated = rows.where("rep_rows > 1").groupBy("cls").agg(*[F.any_value(c).alias(c) for c in columns])
    return rows.where("rep_rows = 1").select("cls", *columns).unionByName(repeated)


def near_duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, miss: float = MISS
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    ``component_id`` is the smallest doc_id that links lead to, the row's own included;
    ``kept`` says that the row has that id. Null and empty texts, and texts of white
    space, have an empty set, no links and stay. Texts of fewer than five words are one
    shingle. Rows, not ids, are the documents: rows that repeat an id and text share
    their result, rows that share an id but not the text are apart unless texts link
    them. A null id is a component's id only if no member has another one. Other
    columns are not read. An empty table gives no rows.
    """
    sets = written(shingle_sets(docs, doc_id, text), "neardup-sets")
    # The text classes, each with a number that is stored before it is used, and the row that stands
    # for it: lowest id, null last.
    alike = sets.where("n_shingles > 0").groupBy("digest", "doc_id", "mark").agg(F.count("*").alias("n"))
    lowest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "n"))
    classes = written(
        alike.groupBy("digest")
        .agg(lowest.alias("row"), F.sum("n").alias("copies"))
        .select("digest", F.col("row.doc_id").alias("rep"), F.col("row.mark").alias("rep_mark"), F.col("row.n").alias("rep_rows"), "copies")
        .withColumn("cls", F.monotonically_increasing_id()),
        "neardup-classes",
    )
    known = sent_if_small(classes.withColumnRenamed("digest", "_digest"), MOST_SENT)
    standing = sets.join(known, (sets["digest"] == known["_digest"]) & _same_row(sets, known))
    nodes = written(_once(standing, "signature").withColumnRenamed("signature", "data"), "neardup-nodes")
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    banded = nodes.select("cls", "data", band.alias("band")).select(
        "cls",
        F.xxhash64("band", F.substring("data", F.col("band") * (4 * ROWS) + 1, 4 * ROWS)).alias("bucket"),
    )
    shared = banded.groupBy("bucket").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("size"))
    members = written(
        banded.join(shared.where("low <> high").select("bucket", "size"), "bucket"), "neardup-members"
    )
    pairs = written(_distinct_pairs(_leader_pairs(members)), "neardup-leaders")
    labels = _joined(None, _links(docs, doc_id, text, pairs, nodes, classes, percent, miss))
    apart = _apart(members, labels)
    x, y = (apart.where(F.col("size") <= SMALL_BUCKET).alias(n) for n in "xy")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component")))
    pairs = written(_distinct_pairs(pairs.select(F.col("x.cls").alias("x"), F.col("y.cls").alias("y"))), "neardup-pairs")
    if not pairs.isEmpty():
        labels = _joined(labels, _links(docs, doc_id, text, pairs, nodes, classes, percent, miss))
        apart = _apart(members, labels)
    crowded = apart.where(F.col("size") > SMALL_BUCKET)
    if not crowded.isEmpty():
        labels = _joined(labels, _block_links(docs, doc_id, text, crowded, nodes, classes, percent, miss))
    return _per_row(sets, classes, labels)


def _links(docs, doc_id, text, pairs, nodes, classes, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that are links: what passes the Bayesian test, checked on full sets."""
    likely = written(_judged(pairs, nodes, _likely(percent, miss)), "neardup-likely")
    named = likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    return written(_judged(likely, _wanted_sets(docs, doc_id, text, named, classes), _exact(percent)), "neardup-links")


def _block_links(docs, doc_id, text, crowded, nodes, classes, percent: int, miss: float) -> DataFrame:
    """Links (a, b) inside crowded buckets.

    Buckets that have members in common form a crowd, so that a pair which shares many
    bands is met once. A crowd is cut into blocks, and a cell is a pair of blocks.
    """
    lowest = crowded.groupBy("bucket").agg(F.min("cls").alias("b"))
    crowds = components(crowded.join(lowest, "bucket").select(F.col("cls").alias("a"), "b"))
    members = crowded.select("cls", "component").distinct().join(
        crowds.select(F.col("node").alias("cls"), F.col("component").alias("crowd")), "cls"
    )
    sets = _wanted_sets(docs, doc_id, text, members.select("cls"), classes)
    signed = nodes.withColumnRenamed("data", "signature")
    rows = written(members.join(sets, "cls").join(signed, "cls").dropDuplicates(["cls"]), "neardup-crowds")
    sizes = rows.groupBy("crowd").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.octet_length("data")) / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    placed = rows.join(sizes, "crowd").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "crowd", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls", "component", "signature", "data"
    )
    cell = ["crowd", "low", "high"]
    near = cells.repartition(*cell).sortWithinPartitions(*cell)
    return written(near.mapInArrow(_in_cells(percent, miss), "a long, b long"), "neardup-cells")


def _in_cells(percent: int, miss: float):
    steps = [(n, needed_matches(n, percent, miss)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield _cell_links(held, steps, percent)
                    held = []
                held.append(row)
        if held:
            yield _cell_links(held, steps, percent)

    return compare


def _cell_links(rows: list[tuple], steps: list[tuple[int, int]], percent: int) -> pa.RecordBatch:
    """The links of one cell, (crowd, low, high, block, cls, component, signature, set) rows."""
    blocks, cls, component = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
    signatures = np.frombuffer(b"".join(r[6] for r in rows), np.uint32).reshape(len(rows), -1)
    bands = signatures.reshape(len(rows), BANDS, ROWS)
    inside = rows[0][1] == rows[0][2]
    left = np.arange(len(rows)) if inside else np.flatnonzero(blocks == rows[0][1])
    right = left if inside else np.flatnonzero(blocks == rows[0][2])
    met = np.zeros((len(left), len(right)), bool)
    for band in range(BANDS):
        # One number for each distinct band value: equal numbers are equal bands.
        number = np.unique(bands[:, band].copy().view("V16").ravel(), return_inverse=True)[1]
        met |= number[left][:, None] == number[right][None, :]
    met &= component[left][:, None] != component[right][None, :]
    a, b = np.nonzero(np.triu(met, 1) if inside else met)
    a, b = left[a], right[b]
    equal, start = np.zeros(len(a), np.int64), 0
    for end, least in steps:
        equal = equal + (signatures[a, start:end] == signatures[b, start:end]).sum(axis=1)
        goes_on = equal >= least
        a, b, equal, start = a[goes_on], b[goes_on], equal[goes_on], end
    sets = [np.frombuffer(r[7], np.uint64) for r in rows]
    common = _common(sets, left, right, a, b)
    sizes = np.array([len(s) for s in sets])
    linked = 100 * common >= percent * (sizes[a] + sizes[b] - common)
    out, root = [], {int(c): int(c) for c in component}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
        p, q = top(int(component[i])), top(int(component[j]))
        if p != q:
            root[p] = q
            out.append((int(cls[i]), int(cls[j])))
    return pa.record_batch([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["a", "b"])


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles each pair has in common: pair by pair, or by matrix products if pairs are many."""
    if len(a) <= 8 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    place_left, place_right = (np.full(len(sets), -1) for _ in "ab")
    place_left[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
    product = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        here = slice(*np.searchsorted(column, [low, low + 2048]))
        one, two = (np.zeros((n, 2048), np.float32) for n in (len(left), len(right)))
        for place, matrix in ((place_left, one), (place_right, two)):
            rows = place[owner[here]]
            matrix[rows[rows >= 0], column[here][rows >= 0] - low] = 1
        product += one @ two.T
    return np.rint(product[place_left[a], place_right[b]]).astype(np.int64)


def _labelled(rows: DataFrame, labels: DataFrame, column: str = "cls") -> DataFrame:
    named = labels.select(F.col("node").alias(column), F.col("component").alias("_component"))
    return rows.join(sent_if_small(named, MOST_SENT), column, "left").select(
        *rows.columns, F.coalesce("_component", column).alias("component")
    )


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold two components or more."""
    rows = written(_labelled(members, labels), "neardup-labelled")
    open_buckets = (
        rows.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("bucket")
    )
    return written(rows.join(open_buckets, "bucket"), "neardup-apart")


def _leader_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's leader: the one with most company in all its buckets."""
    weights = written(members.groupBy("cls").agg(F.sum("size").alias("weight")), "neardup-weights")
    rows = members.join(sent_if_small(weights, MOST_SENT), "cls")
    leaders = rows.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("cls")).alias("c"))).alias("top"))
    return members.join(leaders.select("bucket", (-F.col("top.c")).alias("leader")), "bucket").select(
        F.col("cls").alias("x"), F.col("leader").alias("y")
    )


def _wanted_sets(docs: DataFrame, doc_id: str, text: str, named: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, data): the full shingle sets of the classes ``named`` (cls), from the texts."""
    wanted = written(classes.join(sent_if_small(written(named, "neardup-named"), MOST_SENT), "cls"), "neardup-wanted")
    rows = _marked(docs, doc_id, text)
    texts = _once(rows.join(sent_if_small(wanted, MOST_SENT), _same_row(rows, wanted)), "digest", "text")
    return written(texts.mapInArrow(sparing(_full_sets), "cls long, data binary"), "neardup-full")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The labels after more links: components of components."""
    if labels is None:
        return components(links)
    named = _labelled(_labelled(links, labels, "a").withColumnRenamed("component", "ca"), labels, "b")
    merged = components(named.select(F.col("ca").alias("a"), F.col("component").alias("b")))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = labels.unionByName(
        ends.join(labels.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    )
    higher = merged.select(F.col("node").alias("component"), F.col("component").alias("merged"))
    return written(
        known.join(higher, "component", "left").select("node", F.coalesce("merged", "component").alias("component")),
        "neardup-labels",
    )


def _per_row(sets: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    named = written(_labelled(classes, labels), "neardup-named")
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    # Classes of one row and no link need no join: the row is its own component.
    ids = written(
        named.join(lowest, "component")
        .where("copies > 1 or not (component_id <=> rep)")
        .select(F.col("digest").alias("_digest"), "component_id"),
        "neardup-ids",
    )
    own: Column = F.coalesce(F.col("component_id"), F.col("doc_id"))
    rows = sets.select("doc_id", "n_shingles", "digest")
    return rows.join(sent_if_small(ids, MOST_SENT), rows["digest"] == F.col("_digest"), "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id, and one of its repeats.

    Columns stay as they are. Rows of null or empty text all stay, and so do rows without
    an id.
    """
    groups = written(near_duplicate_groups(docs, doc_id, text), "neardup-groups")
    gone = groups.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = sent_if_small(gone, MOST_SENT)
    rest = docs.join(gone, docs[doc_id].cast("long") == gone["_gone"], "left_anti")
    # Rows that repeat an id: one row of each text stays. The usual case, none, costs no shuffle of texts.
    twice = groups.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    twice = written(twice.select(F.col("doc_id").alias("_twice")), "neardup-twice")
    if twice.isEmpty():
        return rest
    repeated = rest.join(twice, rest[doc_id].cast("long") == twice["_twice"], "left_semi")
    order = Window.partitionBy(doc_id, F.md5(F.col(text).cast("string").cast("binary"))).orderBy(F.lit(0))
    place = free_name(docs.columns, "_place")
    once = repeated.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return rest.join(twice, rest[doc_id].cast("long") == twice["_twice"], "left_anti").unionByName(once)
