"""Exact, near and substring dedup against brute force and edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.llm import exact_dedup, graph, queries, simhash

DOCS = "doc_id long, text string, source string, id string, digest string, fp string, unit string, __keep string"
EDGES = [
    (1, "same text", "a"), (5, "same text", "b"), (5, "same text", "b"), (3, None, "c"), (2, "", "d"), (9, "   ", None), (None, "no id", "e"), (None, None, None),
    (7, "One two three four.", "f"), (8, "one  TWO\tthree four.", "g"), (11, "x " * 30_000, "h"), (12, "É" * 3, "i"),
]


def edge_docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash") for r in EDGES], DOCS)


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op10_exact_dedup", "op9_exact_top_k"])
def test_query_matches_sql(name, spark, sf_dir, same_rows):
    same_rows(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


def test_perfect_hash_is_minimal_and_checks_bytes():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    mph = exact_dedup.PerfectHash.build(words)
    assert sorted(mph.slots(words)) == list(range(5000))
    others = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    slots = mph.slots(others)
    assert slots.max() < 5000 and (slots >= 0).any()  # strangers do land on slots, so digests are compared
    assert len(exact_dedup.PerfectHash.build(words[:0]).slots(others)) == 5000


@pytest.mark.parametrize("historical", [None, "true", "false", "cast(null as boolean)"])
def test_exact_dedup_edges(spark, historical):
    rows = exact_dedup.exact_dedup(edge_docs(spark), historical and F.expr(historical)).collect()
    assert len(rows) == len(EDGES)
    groups = {}
    for doc_id, text, _ in EDGES:
        groups.setdefault(text or "", []).append(doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by_sha[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)


def test_deduplicated_keeps_one_row_and_all_columns(spark):
    docs = edge_docs(spark)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == sorted([5, 3, 9, 0, 7, 8, 11, 12])
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0 == exact_dedup.deduplicated(docs.limit(0)).count()


def slow_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(table))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\t\n\x1cÀz  ", max_size=60))
def test_fingerprint_matches_its_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("bits", [1, 2])
def test_links_lose_no_component(spark, bits):
    rng = random.Random(bits)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            f ^= 1 << rng.randrange(64)
            f ^= (1 << rng.randrange(64)) if rng.random() < 0.5 else 0
    base = rng.getrandbits(64) & ~0xFFFF  # one list with many members
    fps |= {base | rng.getrandbits(16) for _ in range(300)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    found = {r["node"]: r["component"] for r in graph.connected_components(simhash.links(df, bits)).collect()}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    assert [found.get(i, i) for i in range(len(fps))] == components(len(fps), near)


def test_near_duplicates_brute_force(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = simhash.near_duplicates(docs).collect()
    fp = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs.orderBy("doc_id").limit(25).collect()}
    got = {r["doc_id"]: r for r in rows}
    assert all(got[i]["fingerprint"] == f"{f:016x}" for i, f in fp.items())
    ids = sorted(got)
    value = [int(got[i]["fingerprint"], 16) for i in ids]
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (value[i] ^ value[j]).bit_count() <= 2]
    assert [got[i]["component_id"] for i in ids] == [ids[k] for k in components(len(ids), near)]


def test_near_duplicates_edges(spark):
    docs = edge_docs(spark)
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(EDGES)
    blank = [g for g in got if g[0] in (2, 3, 9)]
    assert {g[1:] for g in blank} == {("0" * 16, 2)}
    assert {g[2] for g in got if g[0] in (7, 8)} == {7} and {g[2] for g in got if g[0] in (1, 5)} == {1}
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 7, 11, 12, None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_brute_force(spark):
    """Groups of edited copies: every link is a pair of similar texts, and nearly all similar pairs are found."""
    rng, texts = random.Random(3), []
    for group in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 90, 400]))]
        for _ in range(4):
            copy = list(words)
            for at in rng.sample(range(len(words)), len(words) // 60):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(words[: len(words) // 2] + [f"y{rng.randrange(10**6)}" for _ in words[::2]]))  # shares half
    hot = [f"h{i}" for i in range(60)]
    texts += [" ".join([*hot[:k], f"z{k}", *hot[k + 1 :]]) for k in range(2)] + [" ".join([*hot, f"z{i}"]) for i in range(300)]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = components(len(texts), similar)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert all(want[i] == want[found[i]] for i in range(len(texts)))  # no group joins what brute force does not
    assert sum(found[i] == want[i] for i in range(len(texts))) >= 0.97 * len(texts)
    assert {found[i] for i in range(202, 502)} == {found[202]}


def test_stars_take_every_row_once():
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 60, 2000))
    check = rng.integers(-(2**63), 2**63, 40)[rng.integers(0, 40, 2000)]
    leads, a, b = simhash.stars(key, np.arange(2000), check)
    assert sorted([*np.nonzero(leads)[0], *b]) == list(range(2000)) and leads[a].all()
    assert (key[a] == key[b]).all() and all(((x ^ y) % 2**64).bit_count() <= simhash.TALLY_BITS for x, y in zip(check[a].tolist(), check[b].tolist()))
    assert leads.sum() <= len(set(zip(key.tolist(), check.tolist())))
    assert len(simhash.stars(key[:0], key[:0], check[:0])[0]) == 0


def test_near_copies_edges(spark):
    docs = edge_docs(spark)
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect()}
    assert got == {(1, 1), (5, 1), (3, 2), (2, 2), (9, 2), (7, 7), (8, 7), (11, 11), (12, 12)}
    assert simhash.near_copies(docs.limit(0)).count() == 0 == simhash.representatives(docs.limit(0)).count()


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(5, 5), (None, 3)]
    found = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_lose_no_similar_pair(spark):
    """Pairs just at the threshold, of small and of large sets, and sets that share only common shingles."""
    rng, texts = random.Random(8), []
    for pair in range(400):
        n = rng.choice([5, 10, 20, 45, 90, 270])  # shingles of the lesser set
        words = [f"p{pair}w{i}" for i in range(n + 4)]
        more = n // 4 + (pair % 5 == 4)  # n of n + n // 4 shingles are shared; one more is too many
        texts += [" ".join(words), " ".join(words + [f"p{pair}x{i}" for i in range(more)])]
    common = [[f"c{k}w{i}" for i in range(9)] for k in range(12)]
    texts += [" ".join(w for k in rng.sample(range(12), 6) for w in common[k]) for _ in range(60)]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(similar) >= 320
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert [found[i] for i in range(len(texts))] == components(len(texts), similar)
