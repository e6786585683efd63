"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most four bits differ in at most one
bit of some segment (4 < 3 * 2), so they agree on that segment with one bit left out. Every fingerprint is indexed under
each segment as it stands and under each segment with one bit deleted; equal keys meet and are verified on all 64 bits.

Texts that are similar, rather than fingerprints that are close, take the same index over a longer fingerprint of five-word
shingles (:func:`similar_classes`): 15 segments of 18 bits, each with one bit left out. Two texts whose shingle sets have a
similarity of 0.8 differ in about 15 % of the bits, so they agree on some segment but for one bit with a probability of
about 0.98. What meets there, directly or through others, is one group of candidates. All pairs of a group are verified
on the shingle sets themselves before any is left out, so a close fingerprint that fails never hides a link that holds.

Null and empty texts have fingerprint zero. Rows keep their number: repeated rows get the same class. A null id never
names a class unless all ids of the class are null. Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import FLUSH_BYTES, arrow_schema, components, dropped, map_rows, slices, text_key, utf8, written

SHINGLE = 4
MOST_BITS = 4
SEED = 42
#: (first bit, bits) of each segment: the least number of segments in which one differs by at most one bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of one key that a task compares at once; larger keys are compared block by block.
BLOCK = 4096
#: Words in a shingle and least similarity of two texts' shingle sets, for :func:`similar_classes`.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: The longer fingerprint: words of 64 bits, and the segments (of one width) taken from each.
WORDS = 5
WIDE_SEGMENTS = ((0, 18), (18, 18), (36, 18))
#: Bits of the first two words in which candidates differ at most: 19 are expected at 0.8, with a deviation of 4.
MOST_OF_128 = 34
#: Runs of up to so many rows are first compared by offsets, all runs of a piece at once.
SHORT_RUN = 512
#: Index rows that a task takes in hand at once, but for the rest of the last key.
PIECE = 1 << 16
#: Bytes of text of a group of candidates that a task compares at once; larger groups are compared block by block.
GROUP_BYTES = 8 << 20
#: A table of hot keys is broadcast up to this many rows of 16 bytes, and joined by an exchange beyond.
MOST_BROADCAST = 100_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(raw: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of every run of ``size`` words, repeats included; fewer words make one shingle, no word none."""
    words = raw.translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [digest(joined, SEED)]
    starts = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A bit is one if it is one in over half of a text's shingle hashes."""
    flat, counts = _hashes(texts, SHINGLE)
    return _majority(flat, counts)


def wide_fingerprints(texts: list[bytes], size: int = SIMILAR_SHINGLE, words: int = WORDS) -> list[np.ndarray]:
    """``words`` fingerprints of 64 bits, each of the distinct shingle hashes mixed anew; no shingle gives zeros.

    Repeats count once, as in the similarity of shingle sets.
    """
    flat, counts = _hashes(texts, size, distinct=True)
    return [_majority(_mixed(flat, i), counts) for i in range(words)]


def _hashes(texts: list[bytes], size: int, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in a row, and their number by text."""
    hashes = [shingle_hashes(x, size) for x in texts]
    if distinct:
        hashes = [set(x) for x in hashes]
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    return np.fromiter((x for h in hashes for x in h), dtype=np.uint64, count=int(counts.sum())), counts


def _mixed(flat: np.ndarray, number: int) -> np.ndarray:
    """The hashes for word ``number``: a multiplication by an odd number between two folds spreads all bits."""
    if not number:
        return flat
    odd = np.uint64(xxhash.xxh64_intdigest(b"word", number) | 1)
    folded = (flat ^ (flat >> np.uint64(32))) * odd
    folded = (folded ^ (folded >> np.uint64(29))) * odd
    return folded ^ (folded >> np.uint64(32))


def _majority(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each of ``counts``. Counts eight bits at once in the bytes of a word."""
    out = np.zeros(len(counts), dtype=np.uint64)
    if not len(flat):
        return out
    ends = np.cumsum(counts)
    starts = ends - counts
    pieces = [np.arange(s, e, 255) for s, e in zip(starts.tolist(), ends.tolist())]
    cuts = np.concatenate(pieces)
    owner = np.repeat(np.arange(len(counts)), [len(p) for p in pieces])
    for bit in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(bit)) & _LANES, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.zeros((len(counts), 8), dtype=np.int64)
        np.add.at(ones, owner, lanes)
        for lane in range(8):
            out |= (2 * ones[:, lane] > counts).astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, th, fp)``: 31 bits of the text's hash, and the fingerprint as a signed long."""
    ddl = f"{key} {docs.schema[key].dataType.simpleString()}, th long, fp long"
    schema = arrow_schema(ddl)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", FLUSH_BYTES // 4):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fingerprints(utf8(batch.column(2))).view(np.int64))], schema=schema)

    return map_rows(docs.select(key, text_key(text).alias("th"), F.col(text).cast("string").alias("text")), ddl, made)


def variants(fps: DataFrame) -> DataFrame:
    """Rows ``(bucket, fp)`` for a column ``fp`` of distinct fingerprints: 3 whole segments and 64 segments without a bit.

    ``bucket`` holds the variant's number (0 to 66) above the segment's bits, so keys of different variants never meet. Few
    rows become many, so they are dealt out first: a small file of fingerprints would be read by a few tasks.
    """
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [k for which, (first, width) in enumerate(SEGMENTS) for k in _keys(which, _segment(first, width))]
    return fps.repartition(n, "fp").select(F.explode(F.array(*keys)).alias("bucket"), "fp")


def _segment(first: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))


def _keys(which: int, segment: Column) -> list[Column]:
    """The keys of a segment: as it stands, and without each of its bits."""
    width, number = SEGMENTS[which][1], sum(w + 1 for _, w in SEGMENTS[:which])
    full = (1 << width) - 1
    return [segment.bitwiseAND(F.lit(full ^ gone)).bitwiseOR(F.lit((number + i) << 32)) for i, gone in enumerate((0, *(1 << b for b in range(width))))]


def hot_keys(fps: DataFrame, block: int) -> DataFrame:
    """Rows ``(bucket, n)``: the keys that over ``block`` fingerprints may share, ``n`` at most.

    A key without a bit has the members of two segments, so one of over ``block`` members has a segment of over half as many.
    Segments are counted, three a fingerprint, combined before the exchange, instead of keys, which are 67.
    """
    segments = F.array(*[F.struct(F.lit(i).alias("which"), _segment(*x).alias("segment")) for i, x in enumerate(SEGMENTS)])
    counts = fps.select(F.explode(segments).alias("s")).select("s.which", "s.segment").groupBy("which", "segment").agg(F.count("*").alias("n"))
    many = counts.where(F.col("n") > block // 2)
    found = None
    for which in range(len(SEGMENTS)):
        own = many.where(F.col("which") == which).select(F.explode(F.array(*_keys(which, F.col("segment")))).alias("bucket"), "n")
        found = own if found is None else found.unionAll(own)
    return found.groupBy("bucket").agg((2 * F.max("n")).alias("n"))


def _spanning(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) that connect what links within ``most`` bits connect, by breadth-first search over the rest."""
    left = np.sort(fps)
    members, roots = [], []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= most
            if near.any():
                found = left[near]
                members.append(found)
                roots.append(np.full(len(found), root))
                queue.extend(found)
                left = left[~near]
    if not members:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(members), np.concatenate(roots)


def _runs(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges within each run of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    twos = starts[sizes == 2]
    one, two = fps[twos], fps[twos + 1]
    near = np.bitwise_count((one ^ two).view(np.uint64)) <= most
    members, roots = [np.maximum(one, two)[near]], [np.minimum(one, two)[near]]
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        a, b = _spanning(fps[start : start + size], most)
        members.append(a)
        roots.append(b)
    return np.concatenate(members), np.concatenate(roots)


def _met(index: DataFrame, edges: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows ``(a, b)`` that ``edges(keys, *words)`` gives for rows with equal keys; each partition holds whole keys, in order."""
    schema = arrow_schema("a long, b long")
    width = len(index.columns)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
            n += batch.num_rows
            if n < PIECE:
                continue
            rows = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [[c[cut:] for c in rows]]
            # A key longer than a piece waits for its end, and for as much again before the next look.
            n = 0 if cut else n // 2
            if cut:
                n = len(held[0][0])
                yield found([c[:cut] for c in rows])
        if held:
            yield found([np.concatenate(c) for c in zip(*held)])

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.stack(edges(*rows)), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=schema)

    return index.repartition("bucket").sortWithinPartitions(*index.columns).mapInArrow(verified, "a long, b long")


def _linked(index: DataFrame, hot: DataFrame, edges: Callable[..., tuple[np.ndarray, np.ndarray]], block: int) -> DataFrame:
    """Rows ``(a, b)`` that ``edges`` gives for the rows of ``index (bucket, fp, ...)`` whose keys are equal.

    Equal keys meet by one exchange and are verified in the order of the keys. ``hot (bucket, n)`` names the keys that over
    ``block`` fingerprints share, ``n`` at most. They are kept out of that exchange: their members are dealt to
    blocks by a hash, and each pair of blocks becomes a key of its own, so a task never holds more than about ``block``
    members of a key and no pair is left out. No pairs are listed: a key gives the edges of a spanning forest.
    """
    own = index.columns[1:]
    hot, path = written(hot, "hot")
    n_hot = hot.count()
    if not n_hot:
        dropped(index.sparkSession, path)
        return _met(index, edges)
    small = F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot
    usual = _met(index.join(small.select("bucket"), "bucket", "left_anti").select("bucket", *own), edges)
    # Half a block each, so that a pair of blocks is a block; the number of blocks follows the count.
    dealt = index.join(small, "bucket").withColumn("blocks", F.ceil(F.col("n") * 2 / block).cast("long")).withColumn("mine", F.pmod(F.xxhash64("fp"), "blocks"))
    dealt = dealt.select("bucket", *own, "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).where("mine <> other")
    paired = dealt.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), *own)
    return usual.unionAll(_met(paired, edges))


def links(fps: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` that connect distinct fingerprints exactly as all their links within ``most`` bits do."""
    return _linked(variants(fps), hot_keys(fps, block), lambda keys, prints: _runs(keys, prints, most), block)


def classes(fps: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Rows ``(fp, root)`` for every distinct fingerprint of ``fps (fp)`` that links to another one, roots included."""
    found = components(links(fps, most, block))
    return found.select(F.col("node").alias("fp"), "root").unionAll(found.select(F.col("root").alias("fp"), "root").distinct())


def classed(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_BITS) -> DataFrame:
    """Rows ``(key, th, fp, root, component_id)``: a class is named by ``root``, its smallest fingerprint as a signed long.

    Equal fingerprints are first counted as one, so a group of copies, however large, enters the search once. Classes and
    their names are written before rows and fingerprints join them, so both sides of each join are plain exchanges and
    adaptive execution splits a hot fingerprint or a large class.
    """
    prints, _ = written(with_fingerprints(docs, key, text), "fps")
    groups, groups_path = written(prints.groupBy("fp").agg(F.min(key).alias("low")), "groups")
    found = classes(groups.select("fp"), most)
    named, named_path = written(groups.join(found, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "named")
    low, low_path = written(named.groupBy("root").agg(F.min("low").alias("component_id")), "low")
    names, _ = written(named.join(low, "root").select("fp", "root", "component_id"), "names")
    dropped(prints.sparkSession, groups_path, named_path, low_path)
    return prints.join(names, "fp").select(F.col(key), "th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_BITS) -> DataFrame:
    """One row for each row of ``docs``: the key, ``fp`` and ``component_id``, the smallest key reachable by links."""
    return classed(docs, key, text, most).select(key, "fp", "component_id")


def _segments(prints: DataFrame) -> DataFrame:
    """Rows ``(fp, w1, segment)`` for the words ``fp, w1, ...`` of longer fingerprints; the segment's number is above its bits."""
    segments = []
    for word in ("fp", *(f"w{i}" for i in range(1, WORDS))):
        for first, width in WIDE_SEGMENTS:
            segment = F.shiftrightunsigned(word, first).bitwiseAND(F.lit((1 << width) - 1))
            segments.append(segment.bitwiseOR(F.lit(len(segments) << 32)))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.repartition(n, "fp").select("fp", "w1", F.explode(F.array(*segments)).alias("segment"))


def _without_a_bit(segments: DataFrame, *others: str) -> DataFrame:
    """Rows ``(bucket, *others)``: each ``segment`` without each of its bits. Whole segments that agree agree without any bit."""
    bits = F.sequence(F.lit(0), F.lit(WIDE_SEGMENTS[0][1] - 1))
    bucket = F.expr("(segment & ~shiftleft(1L, out)) | shiftleft(cast(out as bigint), 40)")
    return segments.select("segment", *others, F.explode(bits).alias("out")).select(bucket.alias("bucket"), *others)


def similar_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Candidate edges ``(a, b)`` of ``prints (fp, w1, ...)``, whose ``fp`` are distinct: nearest neighbours among equal keys.

    A key without a bit has the members of two segments, so one of over ``block`` members has a segment of over half as
    many. Segments are counted instead of keys, which are 18 times as many, and twice the larger count bounds the key's.
    """
    segments = _segments(prints)
    many = segments.groupBy("segment").agg(F.count("*").alias("n")).where(F.col("n") > block // 2)
    hot = _without_a_bit(many, "n").groupBy("bucket").agg((2 * F.max("n")).alias("n"))
    return _linked(_without_a_bit(segments, "fp", "w1"), hot, lambda keys, one, two: _closest(keys, one, two, MOST_OF_128), block)


def _closest(keys: np.ndarray, one: np.ndarray, two: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a minimum spanning forest of the links within ``most`` of 128 bits, for each run of equal keys.

    The least distances are kept, as they are the likeliest to hold when the texts are compared.
    """
    sizes = np.diff(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))))
    long_run = np.repeat(sizes > SHORT_RUN, sizes)
    near = long_run.copy()
    short = np.flatnonzero(~long_run)
    k, x, y = keys[short], one[short].view(np.uint64), two[short].view(np.uint64)
    for apart in range(1, SHORT_RUN):
        at = np.flatnonzero(k[apart:] == k[:-apart])
        if not len(at):
            break
        hit = at[np.bitwise_count(x[at] ^ x[at + apart]) + np.bitwise_count(y[at] ^ y[at + apart]) <= most]
        near[short[hit]] = near[short[hit + apart]] = True
    keys, one, two = keys[near], one[near], two[near]
    ends = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    members, roots = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        child, parent = _forest(one[start:end].view(np.uint64), two[start:end].view(np.uint64), most)
        members.append(one[start:end][child])
        roots.append(one[start:end][parent])
    return np.concatenate(members), np.concatenate(roots)


def _forest(one: np.ndarray, two: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Places (child, parent) of a minimum spanning forest, grown from a place by its nearest neighbour outside."""
    least = np.full(len(one), 255, dtype=np.uint8)
    parent = np.zeros(len(one), dtype=np.int64)
    outside = np.arange(1, len(one))
    children, parents, at = [], [], 0
    while len(outside):
        far = np.bitwise_count(one[outside] ^ one[at]) + np.bitwise_count(two[outside] ^ two[at])
        closer = far < least[outside]
        least[outside[closer]] = far[closer]
        parent[outside[closer]] = at
        place = int(least[outside].argmin())
        at = int(outside[place])
        outside = np.delete(outside, place)
        if least[at] <= most:
            children.append(at)
            parents.append(int(parent[at]))
    return children, parents


def similarity(one: bytes, two: bytes, size: int = SIMILAR_SHINGLE) -> float:
    """Shared part of two texts' shingle sets; 1 where neither has a word."""
    a, b = set(shingle_hashes(one, size)), set(shingle_hashes(two, size))
    return len(a & b) / len(a | b) if a or b else 1.0


def alike(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Places (member, root) of edges that connect ``sets`` (distinct hashes each) exactly as all similar pairs do.

    Shared elements are counted for a batch of rows against all rows not yet taken: those of many sets by a product of
    matrices, the others by their lists of sets. What joins a class is taken next, and a single class ends the search.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    if n < 2:
        return [], []
    _, element, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    common = often > max(1, n // 16)
    column = np.cumsum(common) - 1
    dense = np.zeros((n, int(common.sum())), dtype=np.float32)
    kept = common[element]
    dense[owner[kept], column[element[kept]]] = 1
    rare = ~kept & (often[element] > 1)
    rows, own = element[rare], owner[rare]
    order = np.argsort(rows, kind="stable")
    lists, first = own[order], np.searchsorted(rows[order], np.arange(len(often) + 1))
    # The rare elements of each set, as its part of ``rows``: owners ascend.
    part = np.searchsorted(own, np.arange(n + 1))
    label, classes = np.arange(n), n
    taken, waiting, members, roots = np.zeros(n, dtype=bool), [], [], []
    while classes > 1:
        left = np.flatnonzero(~taken)
        waiting = [x for x in dict.fromkeys(waiting) if not taken[x]]
        batch = np.array(waiting[:64] or left[:64])
        if not len(left):
            break
        shared = dense[batch] @ dense[left].T
        for i, counts in zip(batch.tolist(), shared):
            mine = rows[part[i] : part[i + 1]]
            if len(mine):
                starts, lengths = first[mine], first[mine + 1] - first[mine]
                places = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                counts = counts + np.bincount(lists[places], minlength=n)[left]
            both = sizes[i] + sizes[left] - counts
            near = left[np.where(both > 0, counts / np.maximum(both, 1), 1.0) >= least]
            new = near[label[near] != label[i]]
            if len(new):
                others, at = np.unique(label[new], return_index=True)
                members += new[at].tolist()
                roots += [i] * len(at)
                waiting += new.tolist()
                label[np.isin(label, others)] = label[i]
                classes -= len(others)
        taken[batch] = True
    return members, roots


def _similar(groups: DataFrame, least: float) -> DataFrame:
    """Edges ``(a, b)`` that connect the similar texts of each bucket of ``groups (bucket, node, text)``."""
    schema = arrow_schema("a long, b long")

    def found(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        nodes = np.array([x for x, _ in held], dtype=np.int64)
        members, roots = alike([np.array(list(set(shingle_hashes(x, SIMILAR_SHINGLE))), dtype=np.uint64) for _, x in held], least)
        return pa.RecordBatch.from_arrays([pa.array(nodes[members]), pa.array(nodes[roots])], schema=schema)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                if held and bucket != now:
                    yield found(held)
                    held = []
                now = bucket
                held.append((node, raw))
        if held:
            yield found(held)

    return map_rows(groups.repartition("bucket").sortWithinPartitions("bucket"), "a long, b long", checked)


def _groups(members: DataFrame, texts: DataFrame, block: int, most_bytes: int = GROUP_BYTES) -> DataFrame:
    """Rows ``(bucket, node, text)`` of the groups that ``members (node, root)`` names; ``texts`` has a row a node.

    A group of over ``block`` texts or ``most_bytes`` is dealt to blocks by a hash, and each pair of blocks becomes a bucket,
    so that every pair of the group meets in one and a task holds a bounded piece.
    """
    named = members.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    half = F.greatest(F.ceil(F.col("n") * 2 / block), F.ceil(F.col("bytes") * 2 / most_bytes)).cast("long")
    sizes = named.groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("n > 1")
    sizes, _ = written(sizes.select("root", F.when((F.col("n") > block) | (F.col("bytes") > most_bytes), half).otherwise(1).cast("long").alias("blocks")), "sizes")
    dealt = members.join(sizes, "root").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("mine <> other or blocks = 1")
    return dealt.select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "node").join(texts, "node").select("bucket", "node", "text")


def _node(text: str) -> Column:
    """64 bits of the text's hash name a text; null is empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def similar_classes(docs: DataFrame, text: str = "text", least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Rows ``(node, root)`` for texts, named by 64 bits of their hash, that links of similar texts join to another text.

    Fingerprints are made of all rows and counted as one where their first words are equal. Nearest neighbours among equal
    keys, and texts with equal first words, join to groups of candidates, which only serve to bring texts together: the
    nearest neighbours connect all that links within the bits connect. All pairs of a group are verified on the whole
    texts, and only those in question are read again. A link is lost only where no key joins its texts' groups.
    """
    spark = docs.sparkSession
    ddl = "node long, fp long, " + ", ".join(f"w{i} long" for i in range(1, WORDS))
    schema = arrow_schema(ddl)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", FLUSH_BYTES // 4):
            words = wide_fingerprints(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(w.view(np.int64)) for w in words)], schema=schema)

    named = docs.select(_node(text).alias("node"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    prints, prints_path = written(map_rows(named, ddl, made).distinct(), "wide")
    first = F.min(F.struct("node", *(f"w{i}" for i in range(1, WORDS)))).alias("first")
    groups, groups_path = written(prints.groupBy("fp").agg(first).select("fp", "first.*"), "wide-groups")
    near, near_path = written(similar_links(groups, block).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    joined = components(near)
    joined, joined_path = written(joined.select(F.col("node").alias("fp"), "root").unionAll(joined.select(F.col("root").alias("fp"), "root").distinct()), "joined")
    rooted, rooted_path = written(prints.select("node", "fp").join(joined, "fp", "left").select("node", F.coalesce("root", "fp").alias("root")), "rooted")
    several, several_path = written(rooted.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "several")
    members, members_path = written(rooted.join(several, "root", "left_semi"), "members")
    dropped(spark, prints_path, groups_path, near_path, joined_path, rooted_path, several_path)
    texts, texts_path = written(named.join(members.select("node"), "node", "left_semi").dropDuplicates(["node"]), "texts")
    found = components(_similar(_groups(members, texts, block), least))
    dropped(spark, members_path, texts_path)
    return found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())


def one_of_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class of similar texts, five-word shingles and 0.8 unless said otherwise.

    The document with the smallest key that is not null stays, with all its columns; equal texts are similar, and texts
    without a word are similar to each other. Rows that repeat both its key and its text leave.
    """
    found, found_path = written(similar_classes(docs.select(text), text, least), "similar")
    rows = docs.select(F.col(key), text_key(text).alias("th"), _node(text).alias("node"))
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "th")).alias("first")
    # The least row of each text is found before classes are joined, so copies of a text cross no exchange twice.
    least_rows, rows_path = written(rows.groupBy("node").agg(first), "rows")
    texts = least_rows.join(found, "node", "left")
    kept = texts.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept, _ = written(kept, "kept")
    dropped(docs.sparkSession, rows_path, found_path)
    return _kept(docs, kept, key, text)


def _kept(docs: DataFrame, kept: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``first (none, id, th)`` of ``kept`` names, each once."""
    named = kept.select(F.col("first.id").alias("__quire_id"), F.col("first.th").alias("__quire_th"))
    keyed = docs.withColumn("__quire_key", text_key(text))
    chosen = keyed.join(named, keyed[key].eqNullSafe(named["__quire_id"]) & (keyed["__quire_key"] == named["__quire_th"]), "left_semi")
    return chosen.dropDuplicates([key, "__quire_key"]).drop("__quire_key")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_BITS) -> DataFrame:
    """``docs`` with one document of each class of near copies: the one with the smallest key that is not null.

    All columns stay. Of rows with that key and text one stays; of several texts with that key, the one with the smallest hash.
    """
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "th")).alias("first")
    kept = classed(docs.select(key, text), key, text, most).groupBy("root").agg(first)
    return _kept(docs, kept, key, text)
