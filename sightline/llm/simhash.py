"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two fingerprints that differ in at most ``d`` of 64 bits differ in at most ``d`` of their eight bytes, so
they share at least ``8 - d`` positional bytes. The index therefore posts each distinct fingerprint under every
choice of that many positions (28 for d = 2) with the bytes there: two fingerprints meet in a list exactly if their
tally of shared positional bytes reaches the guaranteed minimum, and no list of single bytes, which would hold 1/256
of the corpus, is ever joined with itself. A list has at most 2^(8d) members whatever the corpus. Inside a list pairs are
verified on the bytes left over by probing for common one-bit neighbours, which is linear, and only a
spanning forest of each list leaves it, so no group emits all its pairs and no link between fingerprints
is lost to the components.

Copies that an editor has changed differ in more bits than that. ``near_copies`` therefore takes a fingerprint of 64 bytes
over the set of a text's shingles, posts it under fixed choices of three positional bytes, tallies the bits that a
list's members share with its first, and verifies what remains by the shingles themselves. Similar sets may still never meet in a
list, so a prefix filter over the shingles then compares the groups that the lists have made with each other, and no similar pair is
lost to them: sets of the similarity wanted share one of their rarest shingles.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import discard, fresh, release_shuffles, staged, text_or_empty
from sightline.llm.graph import connected_components
from sightline.llm.words import ragged, slices

SEED = 42


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of a text: A-Z lower-cased, words between ASCII blanks, shingles with repeats, XXH64 of each.

    Fewer words than ``width`` make one shingle of all of them, none make fingerprint 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of ``docs(doc_id, text)``; fp is the fingerprint's bits as a signed long, a null text counts as empty."""

    def batches(it):
        for b in it:
            fps = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(batches, "doc_id long, fp long")


def _masks(bits: int) -> list[int]:
    """Masks of every choice of the positional bytes that must be shared."""
    return [sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(8), max(1, 8 - bits))]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over n items: a root for each."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)])


def list_links(fps: np.ndarray, bits: int, free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (indices) of one list's fingerprints that differ in at most ``bits`` (1 or 2) of the ``free`` bit positions.

    Two fingerprints within two bits have a common neighbour at one bit or are neighbours; each posts itself and, for two bits, its
    one-bit neighbours, and whoever shares such a value is linked in a chain.
    """
    flips = np.array([0] + [1 << p for p in free], dtype=np.uint64)
    if bits == 1:  # a neighbour must be a member itself
        order = np.argsort(fps)
        at = np.searchsorted(fps[order], fps[:, None] ^ flips[1:])
        there = fps[order][np.minimum(at, len(fps) - 1)] == (fps[:, None] ^ flips[1:])
        a, b = np.nonzero(there)[0], order[np.minimum(at, len(fps) - 1)[there]]
    else:
        probe, owner = (fps[:, None] ^ flips).ravel(), np.repeat(np.arange(len(fps)), len(flips))
        order = np.argsort(probe, kind="stable")
        probe, owner = probe[order], owner[order]
        same = probe[1:] == probe[:-1]
        a, b = owner[1:][same], owner[:-1][same]
    root = _roots(len(fps), a, b)
    linked = np.nonzero(root != np.arange(len(fps)))[0]
    return linked, root[linked]


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): spanning links between ``distinct(fp, rep)`` of fingerprints that differ in at most ``bits`` (0 to 2)."""
    if not 0 <= bits <= 2:
        raise ValueError("bits is 0, 1 or 2")
    if bits == 0:
        return distinct.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    masks = _masks(bits)
    free = [[p for p in range(64) if not m >> p & 1] for m in masks]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posts = distinct.filter("rep is not null").select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("pick", "bytes"))
    posts = posts.repartition("pick", "bytes").sortWithinPartitions("pick", "bytes")

    def lists(it):
        held = None
        for b in it:
            now = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("fp", "rep", "pick", "bytes")}
            held = now if held is None else {k: np.concatenate([held[k], now[k]]) for k in now}
            new = np.nonzero((held["pick"][1:] != held["pick"][:-1]) | (held["bytes"][1:] != held["bytes"][:-1]))[0] + 1
            if len(new):
                yield verified({k: v[: new[-1]] for k, v in held.items()}, new[:-1])
                held = {k: v[new[-1] :] for k, v in held.items()}
        if held is not None:
            yield verified(held, np.zeros(0, np.int64))

    def verified(rows, cuts):
        """Whole lists, cut at the given rows, to their links."""
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(rows["fp"])]]))
        fps, reps = rows["fp"].view(np.uint64), rows["rep"]
        two = starts[sizes == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits
        a, b = [reps[two[near]]], [reps[two[near] + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            x, y = list_links(fps[s : s + n], bits, free[rows["pick"][s]])
            a.append(reps[s + x])
            b.append(reps[s + y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return posts.mapInArrow(lists, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most ``bits`` differing fingerprint bits reach, itself included.
    Null texts are empty; texts without words share fingerprint 0 and are linked. A null doc_id gets the component of
    its fingerprint's other rows, or null. Equal fingerprints meet as one row, so copies cost nothing in the index.
    """
    rows = staged(fingerprints(docs, width), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    found = connected_components(links(distinct, bits))
    named = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SKETCH_BYTES = 64
KEY_BYTES = 3
#: Choices of positional bytes that a sketch is posted under: eight deals of its 64 bytes into 21 triples.
PICKS = np.array([np.random.RandomState(7 + k).permutation(SKETCH_BYTES)[: SKETCH_BYTES // KEY_BYTES * KEY_BYTES].reshape(-1, KEY_BYTES) for k in range(8)]).reshape(-1, KEY_BYTES)
#: Odd multipliers that make eight words of one shingle hash.
SPREAD = np.array([(0x9E3779B97F4A7C15 * k & (1 << 64) - 1) | 1 for k in range(1, 9)], dtype=np.uint64)
#: Parts of the shingles' hashes for each shuffle partition; a task counts the shingles of one part at a time.
PARTS_PER_PARTITION = 4
#: Pairs that are compared at once.
PAIRS_AT_ONCE = 500_000
#: A list's members are one cluster if at most this many of 64 bits differ; similar texts differ in about 10, unlike ones in 32.
TALLY_BITS = 22


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles (A-Z lower-cased; fewer words than ``width`` make one, none make an empty set)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8"))


def digest_of(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a shingle set."""
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def sketch(shingles: np.ndarray) -> bytes:
    """The 64-byte SimHash of a shingle set; a tied bit is that of the least shingle, so that small sets are not biased to zeros."""
    ones, first = np.zeros(8 * SKETCH_BYTES, np.int64), None
    for i in range(0, len(shingles), 4096):
        x = shingles[i : i + 4096, None] * SPREAD
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.view(np.uint8), axis=1)
        first = bits[0] if first is None else first
        ones += bits.sum(axis=0, dtype=np.int64)
    if first is None:
        return bytes(SKETCH_BYTES)
    return np.packbits((ones * 2 > len(shingles)) | ((ones * 2 == len(shingles)) & (first == 1))).tobytes()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, sketch) of ``docs(doc_id, text)``, and besides the shingles of each slice of documents by parts of their hashes.

    A slice has a row for each part, ``keys`` with four bytes of each shingle's hash and ``at`` with its document's number in the slice,
    and one of part -1, with the documents' digests and numbers of shingles. Documents of equal sets are one in a slice.
    """
    parts = np.uint64(PARTS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def batches(it):
        for b in it:
            for whole in slices(b, "text"):
                for part in (whole.slice(i, 1 << 16) for i in range(0, whole.num_rows, 1 << 16)):
                    sets = [shingle_set(t, width) for t in part.column(1).to_pylist()]
                    digests = np.array([digest_of(s) for s in sets], np.int64)
                    yield rows(part.num_rows, doc_id=part.column(0), digest=digests, sketch=pa.array([sketch(s) for s in sets], pa.binary()))
                    firsts = np.unique(digests, return_index=True)[1]
                    yield packed(digests[firsts], [sets[i] for i in firsts.tolist()])

    def packed(digests, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        flat, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes).astype("<u2")
        of, keys = ((flat >> np.uint64(32)) % parts).astype(np.int32), flat.astype("<u4")
        order = np.argsort(of, kind="stable")
        of, keys, at = of[order], keys[order], at[order]
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else [0]
        each = list(zip(cuts, cuts[1:]))
        return rows(
            len(each) + 1,
            slice=np.full(len(each) + 1, digest_of(digests)),
            part=np.array([-1, *of[cuts[:-1]]], np.int32),
            keys=pa.array([digests.astype("<i8").tobytes(), *(keys[i:j].tobytes() for i, j in each)], pa.binary()),
            at=pa.array([sizes.astype("<i8").tobytes(), *(at[i:j].tobytes() for i, j in each)], pa.binary()),
        )

    def rows(n, **columns):
        kinds = {"doc_id": pa.int64(), "digest": pa.int64(), "sketch": pa.binary(), "slice": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "at": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(columns[k]) if k in columns else pa.nulls(n, kind) for k, kind in kinds.items()], names=list(kinds))

    schema = "doc_id long, digest long, sketch binary, slice long, part int, keys binary, at binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(batches, schema)


def by_list(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The order of rows by list; within lists one of four orders of nodes, which the list's choice of bytes names, so that leaders vary."""
    return np.lexsort((node * SPREAD[: 4].view(np.int64)[key >> 8 * KEY_BYTES & 3], key))


def stars(key: np.ndarray, node: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of key to (which rows lead, leaders, their members): a row joins the first leader of its list within ``TALLY_BITS``, else leads."""
    starts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    leads, a, b, check = np.ones(len(key), bool), [], [], check.view(np.uint64)  # the count of a negative number is that of its absolute value
    two = starts[sizes == 2]
    two = two[np.bitwise_count(check[two] ^ check[two + 1]) <= TALLY_BITS]
    leads[two + 1] = False
    a.append(node[two])
    b.append(node[two + 1])
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        left = np.arange(s, s + n)
        while len(left) > 1:
            near = np.bitwise_count(check[left[1:]] ^ check[left[0]]) <= TALLY_BITS
            members = left[1:][near]
            leads[members] = False
            a.append(np.full(len(members), node[left[0]]))
            b.append(node[members])
            left = left[1:][~near]
    return leads, np.concatenate(a), np.concatenate(b)


def candidates(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of digests of ``distinct(digest, sketch)`` to verify, a star for each cluster of each list.

    A batch links its own clusters before it posts, so a group of copies reaches the shuffle as one row a key and batch, whatever its size.
    A task holds the leaders of one list. Members of a list that are all unlike each other cost their square; by chance a list holds
    one in 2^24 of the distinct texts.
    """

    def posts(it):
        for b in it:
            node = b.column(0).to_numpy(zero_copy_only=False)
            if not len(node):
                continue
            values = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, SKETCH_BYTES)
            check = values[:, :8].copy().view(np.int64).ravel()
            key = np.broadcast_to(np.arange(len(PICKS), dtype=np.int64), (len(node), len(PICKS)))
            for p in range(KEY_BYTES):
                key = key << 8 | values[:, PICKS[:, p]]
            node, check, key = np.repeat(node, len(PICKS)), np.repeat(check, len(PICKS)), key.ravel()
            order = by_list(key, node)
            node, check, key = node[order], check[order], key[order]
            leads, a, b = stars(key, node, check)
            near = np.unique(np.stack([a, b], axis=1), axis=0)
            yield rows(key[leads], node[leads], check[leads], None)
            yield rows(near[:, 1] ^ near[:, 0], near[:, 1], np.zeros(len(near), np.int64), near[:, 0])

    def rows(key, node, check, leader):
        leader = pa.array(leader, pa.int64()) if leader is not None else pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(check), leader], names=["key", "node", "check", "leader"])

    def lists(it):
        held = [np.zeros(0, np.int64)] * 3
        for b in it:
            done = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            yield links_of(b.column(3).drop_null().to_numpy(zero_copy_only=False), now[1][done])
            key, node, check = (np.concatenate([h, n[~done]]) for h, n in zip(held, now))
            order = by_list(key, node)
            key, node, check = key[order], node[order], check[order]
            leads, a, b = stars(key, node, check)
            yield links_of(a, b)
            if len(key):
                last = leads & (key == key[-1])
                held = [key[last], node[last], check[last]]

    def links_of(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    posted = distinct.select("digest", "sketch").mapInArrow(posts, "key long, node long, check long, leader long")
    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(lists, "a long, b long").distinct()


def prefixes(packed: DataFrame, similarity: float) -> DataFrame:
    """(key, digest, size, rest): the rarest shingles of each set that others have too, from the slices of ``sketches``.

    Shingles are ordered by how many sets hold their key, then by key. A set of n shingles shares at least ``similarity * n`` with any that
    is similar, so both hold one of the first ``n - ceil(similarity * n) + 1``; ``rest`` counts a set's shingles from the key on. Keys of
    one set alone are counted only; keys that two shingles have by chance make more lists, never fewer.
    """

    def counted(table):
        keys, at = ([np.frombuffer(x, kind) for x in table.column(k).to_pylist()] for k, kind in (("keys", "<u4"), ("at", "<u2")))
        _, which, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        out, start = [], 0
        for k, d in zip(keys, at):
            n = times[which[start : start + len(k)]]
            start += len(k)
            often = n > 1
            out.append((k[often].tobytes(), d[often].tobytes(), n[often].astype("<u4").tobytes()))
        columns = [table.column("slice"), table.column("part"), *(pa.array(x, pa.binary()) for x in zip(*out))]
        return pa.table(columns, names=["slice", "part", "keys", "at", "times"])

    def leading(table):
        part = table.column("part").to_numpy()
        keys, at, times = (table.column(k).to_pylist() for k in ("keys", "at", "times"))
        own = int(np.flatnonzero(part == -1)[0])
        digests, sizes = np.frombuffer(keys[own], "<i8"), np.frombuffer(at[own], "<i8")
        others = np.flatnonzero(part >= 0).tolist()
        key = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(keys[i], "<u4").astype(np.int64) | int(part[i]) << 32 for i in others)])
        of = np.frombuffer(b"".join(at[i] for i in others), "<u2").astype(np.int64)
        order = np.lexsort((key, np.frombuffer(b"".join(times[i] for i in others), "<u4"), of))
        key, of = key[order], of[order]
        count = np.bincount(of, minlength=len(sizes))
        rest = (np.cumsum(count))[of] - np.arange(len(of))
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])[: len(of)]
        take = first & (rest >= np.ceil(similarity * sizes - 1e-6)[of])
        of = of[take]
        return pa.table([pa.array(key[take]), pa.array(digests[of]), pa.array(sizes[of]), pa.array(rest[take])], names=["key", "digest", "size", "rest"])

    often = packed.filter("part >= 0").groupBy("part").applyInArrow(counted, "slice long, part int, keys binary, at binary, times binary")
    slices = often.union(packed.filter("part = -1").select("slice", "part", "keys", "at", F.lit(None).cast("binary")))
    return slices.groupBy("slice").applyInArrow(leading, "key long, digest long, size long, rest long")


def left_over(lists: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of digests to verify among ``lists(key, digest, size, rest, group)``, of one key and different groups.

    Of a pair that may reach the similarity, one key at least passes the test of what both sets hold from it on. Members of one group are
    not compared, so a group of copies costs its rows; lists of many groups cost their square.
    """

    def pairs(it):
        held = [np.zeros(0, np.int64)] * 5
        for b in it:
            held = [np.concatenate([h, b.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            new = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            if len(new):
                yield from compared(*(x[: new[-1]] for x in held))
                held = [x[new[-1] :] for x in held]
        yield from compared(*held)

    def compared(key, digest, size, rest, group):
        if len(key) < 2:
            return
        other = key[1:] != key[:-1]
        list_end, group_end = (ends(x, len(key)) for x in (other, other | (group[1:] != group[:-1])))
        count = list_end - group_end
        rows = np.flatnonzero(count)
        batch = np.cumsum(count[rows]) // PAIRS_AT_ONCE
        for some in np.split(rows, np.flatnonzero(batch[1:] != batch[:-1]) + 1):
            i, j = np.repeat(some, count[some]), ragged(group_end[some], count[some])
            near = np.minimum(rest[i], rest[j]) >= similarity / (1 + similarity) * (size[i] + size[j]) - 1e-6
            i, j = digest[i[near]], digest[j[near]]
            found = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def ends(change, n):
        at = np.concatenate([np.flatnonzero(change) + 1, [n]])
        return np.repeat(at, np.diff(at, prepend=0))

    rows = lists.select("key", "digest", "size", "rest", "group").repartition("key").sortWithinPartitions("key", "group")
    return rows.mapInArrow(pairs, "a long, b long").distinct()


def verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of digests whose whole shingle sets have a Jaccard similarity of at least ``similarity``; staged."""
    ends = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct().join(distinct, "digest").select("doc_id").distinct()

    def sets(it):
        for b in it:
            for part in slices(b, "text"):
                of = [shingle_set(t, width) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest_of(s) for s in of], pa.int64()), pa.array([s.view(np.int64) for s in of], pa.list_(pa.int64()))], names=["digest", "shingles"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(ends, "doc_id", "left_semi")
    sets = staged(texts.select("text").mapInArrow(sets, "digest long, shingles array<long>").dropDuplicates(["digest"]), "shingle-sets")
    first, second = (sets.select(F.col("digest").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    near = pairs.join(first, "a").join(second, "b").filter(shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")
    near = staged(near, "near-pairs")
    discard(docs.sparkSession, sets)
    return near


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with a doc_id: doc_id, component_id.

    component_id is the smallest doc_id that links reach, itself included; a link is any pair whose sets of ``width``-word shingles have a
    Jaccard similarity of at least ``similarity``, counted over the whole sets. Pairs from ``candidates`` make groups, and ``left_over``
    compares what these groups' members share, so no link between groups is lost. Texts of equal sets are
    linked; null texts are empty, and all texts without words are equal. An empty table gives an empty result, other columns are not read.
    """
    spark = docs.sparkSession
    found = staged(sketches(docs.filter("doc_id is not null"), width), "sketches")
    rows = staged(found.filter("slice is null").select("doc_id", "digest", "sketch"), "set-digests")
    lists = staged(prefixes(found.filter("slice is not null"), similarity), "prefixes")
    discard(spark, found)  # before the lists of sketches are dealt
    release_shuffles(spark)
    distinct = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch")), "distinct-sketches")
    pairs = staged(candidates(distinct), "candidates")
    release_shuffles(spark)
    near = verified(docs, distinct, pairs, width, similarity)
    release_shuffles(spark)

    def groups(near):
        return distinct.join(connected_components(near), F.col("digest") == F.col("node"), "left").select("digest", "doc_id", F.coalesce("component", "digest").alias("group"))

    lists = lists.join(groups(near).select("digest", "group"), "digest")
    near = near.union(verified(docs, distinct, staged(left_over(lists, similarity), "left-over"), width, similarity))
    joined = groups(near)
    least = joined.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return rows.join(joined.join(least, "group").select("digest", "component_id"), "digest").select("doc_id", "component_id")


def representatives(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the document of smallest doc_id of each group of near copies, all columns kept; rows without a doc_id stay."""
    name = fresh(docs, "kept_id")
    kept = near_copies(docs, width, similarity).filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    found = docs.join(kept, F.col("doc_id") == F.col(name), "left")
    return found.filter(F.col("doc_id").isNull() | F.col(name).isNotNull()).drop(name)
