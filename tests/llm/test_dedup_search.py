"""SimHash groups and top-k search against brute force."""

import random

import numpy as np
import pytest
import xxhash
from conftest import SF_SMALL
from llm_fixtures import empty, messy  # noqa: F401

from hourbook.llm import simhash, topk_search
from hourbook.llm.common import documents
from hourbook.llm.queries import QUERIES


def plain_fingerprint(text, words_of):
    words = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(items, near):
    """items: (key, fp) -> smallest root by union-find over all pairs."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(items))]


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_fingerprint_is_the_plain_one():
    rng = random.Random(3)
    texts = [None, "", " \t", "One", "two words", "Ünder ÄÖ x", "a\x0bb\x0cc\rd", "e f g h i"]
    texts += [" ".join(rng.choices(["A", "b", "CC", "dé"], k=rng.randint(1, 400))) for _ in range(30)]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t, words_of)


def test_fingerprint_of_long_text_in_parts(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole


def test_linked_halves_share_an_anchor():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63, dtype=np.int64)) * 2 + int(rng.integers(2))
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= 1 << int(bit)
        keys = simhash.anchors(np.array([a, b], np.uint64))
        assert set(keys[0]) & set(keys[1])
        assert len(set(keys[0])) <= 32


@pytest.mark.parametrize("limit", [simhash.ANCHOR_LIMIT, 5])
def test_links_match_all_pairs(spark, limit):
    """Also with anchors so small that dense ones are redone in blocks."""
    rng = random.Random(5)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), 3, limit)
    found = {r["node"]: r["root"] for r in simhash.connected_components(links).collect()}
    want = plain_groups(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    by_root, got_root = {}, {}
    for i, x in enumerate(signed):
        by_root.setdefault(want[i], set()).add(x)
        got_root.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, got_root.values()))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    random.Random(1).shuffle(edges)
    out = {r["node"]: r["root"] for r in simhash.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}
    assert simhash.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_matches_brute_force(spark):
    docs = documents(spark, SF_SMALL).collect()
    rows = {r["doc_id"]: r for r in QUERIES["op2_simhash_near_dedup"](spark, SF_SMALL).collect()}
    items = [(d["doc_id"], plain_fingerprint(d["text"], words_of)) for d in sorted(docs, key=lambda d: d["doc_id"])]
    want = plain_groups(items, lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    assert len(rows) == len(items)
    for (doc, fp), root in zip(items, want):
        assert rows[doc]["fingerprint"] == f"{fp:016x}"
        assert rows[doc]["component_id"] == items[root][0]


def test_messy_documents(messy, empty):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    zero = [r for r in rows if r["fp"] == 0]
    assert {r["doc_id"] for r in zero} == {100, 101, 102, None} and {r["component_id"] for r in zero} == {100}
    assert {r["component_id"] for r in rows if r["doc_id"] == 104} == {3}
    kept = simhash.keep_one_per_group(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len({r["root"] for r in rows})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one_per_group(empty).count() == 0


def plain_top_k(rows, queries, k):
    codes = {i: sum(1 << b for b, x in enumerate(v) if x is not None and x > 0) for i, v in rows if v is not None and i is not None}
    out = set()
    for q in queries:
        if q in codes:
            near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:k]
            out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near)}
    return out


@pytest.mark.parametrize("block", [topk_search.BLOCK_CODES, 40])
def test_top_k_with_ties_repeats_and_nulls(spark, block):
    rng = random.Random(2)
    base = [[rng.choice([-1.0, 1.0]) for _ in range(64)] for _ in range(60)]
    rows = [(i, base[i % 60] if i % 3 else base[0]) for i in range(200)]
    rows += [(500, None), (501, [None] * 64), (502, [float("nan")] * 64), (503, [-1.0] * 64), (None, base[1])]
    df = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>").selectExpr("*", "'x' AS code", "1 AS block").repartition(4)
    got = topk_search.top_k(df, df.filter("vec_id % 20 = 0 or vec_id > 499"), 7, block_codes=block).collect()
    want = plain_top_k(rows, [i for i, _ in rows if i is not None and (i % 20 == 0 or i > 499)], 7)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk_search.top_k(df, df, 5).collect()} == {(1, 1, 2, 1), (2, 1, 1, 1)}
    assert topk_search.top_k(df.limit(0), df.limit(0), 5).count() == 0
    assert topk_search.top_k(df.limit(0), df, 5).count() == 0


def test_vectors_of_more_than_64_elements_are_refused(spark):
    def pair(width):
        rows = [(1, [1.0] * width), (2, [1.0] * (width - 1) + [-1.0])]
        return spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    assert {tuple(r) for r in topk_search.top_k(pair(64), pair(64), 1).collect()} == {(1, 1, 2, 1), (2, 1, 1, 1)}
    with pytest.raises(Exception, match="at most 64 elements, not 65"):
        topk_search.top_k(pair(65), pair(65), 1).collect()


def test_hot_copies_and_a_hot_root(spark):
    """A third of all rows are equal, and one component holds another third."""
    common = " ".join(f"word{i}" for i in range(300))
    near = [common.replace(f"word{i} ", f"other{i} ") for i in range(200)]
    rows = [(9000, "all the same words here " * 20, "en", "s", 1)] * 200 + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(near)]
    rows += [(i, f"text number {i} " + " ".join(f"w{i}x{j}" for j in range(40)), "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    marks = {i: plain_fingerprint(t, words_of) for i, t, *_ in rows}
    items = sorted(marks.items())
    roots = plain_groups(items, lambda a, b: (a[1] ^ b[1]).bit_count() <= simhash.MAX_BITS)
    assert got == {items[i][0]: items[r][0] for i, r in enumerate(roots)}
    kept = simhash.keep_one_per_group(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({items[r][0] for r in roots})
    # whole rows are joined by their number alone, and sorted in no window
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and kept.columns == docs.columns
