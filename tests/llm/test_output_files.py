"""Token files, packing, sharding and mixing."""

import collections
import math
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF_SMALL
from llm_fixtures import empty, messy  # noqa: F401
from tokenizers import Tokenizer

from hourbook.llm import encoding, feistel, mixing, packing, sharding, token_files
from hourbook.llm.common import documents
from hourbook.llm.queries import QUERIES
from pyspark.sql import functions as F

BYTE, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "", " ", "  ", "a  b", "a   b", " a ", "a\n b", "a \nb", "x  y", "don't 's 't.", "<|endoftext|> a<|endoftext|>.", "a\tb c\t d",
    "á ́b é", "日本 語", "a\r\nb  \n c", "12 34 .. ?? 3.14, x", "ΣΑΣ οδΟΣ Σ.", "İ I",
    "<|ENDOFTEXT|> X", "a\x01b", "the. Of\nthe, end.\n\nNew", "(a). [b], c", "e.g. i.e., Mr.X", "%%% a.&&& b", "no!! ab### x*y*z 5% a&b é$$, q.*", "a! <|endoftext|> b!", None,
    "ÀÉÎ Ÿÿ ßẞ ŉ ǆ ǅ Ǆ ſt K Å", "İstanbul Iı ǰ ΐ", "ÀÉ\u0301 e\u0308x é\u0308", "x×y÷z ªº µ", "it's we'll l's 'S", "ɏɐ ȺȾ Ɂɂ", "foo</w> </w>bar <w/>", "ÿ." * 3,
]


@pytest.mark.parametrize(("path", "cut"), [(BYTE, "lead"), (WORDS, "drop"), (WORDS, None)])
def test_pieces_encode_like_whole_texts(path, cut):
    rng = np.random.default_rng(0)
    letters = list("ab 1 .,\n\t' sé́日\r !#*")
    texts = ODD + ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    plain = Tokenizer.from_file(path)
    want = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 9], "<u4").tobytes() for t in texts]
    encoder = encoding.Encoder(path, cut, 9)
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[::-1]) == want[::-1]


def test_old_pieces_are_found_again(monkeypatch):
    monkeypatch.setattr(encoding, "CACHED_PIECES", 3)
    encoder, plain = encoding.Encoder(BYTE, "lead", 0), Tokenizer.from_file(BYTE)
    for text in ["a b c d e", "e f g a b", "x y z", "a b c", "a b c d e"]:
        want = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert encoder.encode([text]) == [want]


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_hold_the_ids(spark, messy, empty):
    plain = Tokenizer.from_file(BYTE)
    files = token_files.write_tokens(messy, BYTE, 0, "lead", 50257)
    assert files.width == 2
    rows = sorted(token_files.read_tokens(spark, files, with_ids=True).collect(), key=lambda r: r["start"])
    start = 0
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"])
        start += r["n_tokens"]
    assert start == files.tokens
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert order == sorted(order)
    want = collections.Counter((d["doc_id"], tuple(ids_of(plain, d["text"], 0))) for d in messy.select("doc_id", "text").collect())
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    none = token_files.write_tokens(empty, BYTE, 0, "lead", 50257)
    assert none.tokens == 0 and token_files.read_tokens(spark, none).count() == 0


def test_wide_ids(spark, messy):
    few = messy.filter("doc_id < 4")
    wide, narrow = (token_files.write_tokens(few, BYTE, 0, "lead", n) for n in (100_000, 50257))
    assert wide.width == 4
    rows = lambda f: sorted(map(tuple, token_files.read_tokens(spark, f).collect()))
    assert rows(wide) == rows(narrow)


def test_token_query(spark):
    plain = Tokenizer.from_file(BYTE)
    got = {r["doc_id"]: r for r in QUERIES["op3_token_files"](spark, SF_SMALL).collect()}
    start = 0
    for d in documents(spark, SF_SMALL).orderBy("doc_id").collect():
        ids = ids_of(plain, d["text"], 0)
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def check_packing(rows, docs, capacity, tokenizer, end):
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = collections.Counter()
    for d in docs:
        ids = ids_of(tokenizer, d["text"], end)
        for i in range(0, len(ids), capacity):
            own = ids[i : i + capacity]
            want[(d["doc_id"], i // capacity, i, len(own), crc(own))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(by_sequence), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_query(spark):
    rows = QUERIES["op6_best_fit_packing"](spark, SF_SMALL).collect()
    used, least = check_packing(rows, documents(spark, SF_SMALL).collect(), 4096, Tokenizer.from_file(WORDS), 1)
    assert used <= least * 1.02 + 1


def test_packing_messy(messy, empty):
    docs = messy.select("doc_id", "text").collect()
    rows = packing.pack_documents(messy, WORDS, 1, "drop", capacity=256).collect()
    used, least = check_packing(rows, docs, 256, Tokenizer.from_file(WORDS), 1)
    assert used <= least * 1.05 + 2
    whole = packing.packed_sequences(messy, WORDS, 1, "drop", capacity=256).collect()
    assert len(whole) == used
    for s in whole:
        assert len(s["ids"]) == 4 * s["n_tokens"] == 4 * sum(p["length"] for p in s["parts"])
        assert [p["offset"] for p in s["parts"]] == list(np.cumsum([0, *(p["length"] for p in s["parts"])])[:-1])
    assert packing.pack_documents(empty, WORDS, 1, "drop").count() == 0


@pytest.mark.parametrize("kind", ["short", "long", "halves", "mixed", "one"])
def test_plan_uses_all_and_is_tight(kind):
    rng = np.random.default_rng(1)
    lengths = {
        "short": rng.integers(1, 60, 5000), "long": rng.integers(3000, 4097, 500), "halves": np.full(301, 2048),
        "mixed": np.minimum(4096, rng.lognormal(6.5, 1, 4000).astype(int) + 1), "one": np.array([17]),
    }[kind]
    histogram = dict(collections.Counter(lengths.tolist()))
    groups = packing.plan(histogram)
    used = collections.Counter()
    for n, held in groups:
        assert n > 0 and sum(held) <= 4096
        for length in held:
            used[length] += n
    assert used == histogram
    rows = packing.plan_rows(groups, histogram)
    covered = sorted((a, b) for _, a, b, _, _ in rows)
    assert covered[0][0] == 0 and all(x[1] == y[0] for x, y in zip(covered, covered[1:])) and covered[-1][1] == len(lengths)
    bound = max(-(-int(lengths.sum()) // 4096), int((lengths > 2048).sum()))
    assert sum(n for n, _ in groups) <= bound * 1.01 + 1


def test_least_squares_counts_are_not_negative():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 3, (12, 40)).astype(float)
    truth = np.where(rng.random(40) < 0.2, rng.integers(1, 50, 40), 0)
    x = packing.fit_patterns(a, a @ truth)
    assert (x >= 0).all() and np.abs(a @ x - a @ truth).max() < 1e-3


def plain_image(x, n, key, seed):
    a = max(1, math.ceil(math.sqrt(n)))
    sizes = [a, max(1, math.ceil(n / a))]
    left, right = divmod(x, sizes[1])
    for k in feistel.round_keys(seed):
        t = ((right + key + k) % feistel.PRIME) * feistel.STEP % feistel.PRIME
        left, right = right, (left + (t * t + k) % feistel.PRIME * feistel.STEP % feistel.PRIME) % sizes[0]
        sizes.reverse()
    return left * sizes[1] + right


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 13, 30, 1000, 4097])
def test_permutation(spark, n):
    for key in (0, 11):
        frame = spark.range(n).select(F.col("id"), F.lit(n).cast("long").alias("_n"), F.lit(key).cast("long").alias("_key"))
        steps = feistel.walk_steps(frame.select("_n", "_key").limit(1), 4)
        got = {r["id"]: r["p"] for r in feistel.permute(frame, "id", "p", 4, steps).collect()}
        assert sorted(got.values()) == list(range(n))
        for x in range(0, n, 37):
            y = plain_image(x, n, key, 4)
            while y >= n:
                y = plain_image(y, n, key, 4)
            assert got[x] == y


def test_shards(messy, empty):
    rows = sharding.shard_documents(messy, 16).collect()
    texts = collections.Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in messy.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(16))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard_documents(empty).count() == 0
    again = sharding.shard_documents(messy.repartition(5), 16).collect()
    place = lambda x: collections.Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in x)
    assert place(rows) == place(again)


WEIGH, SPACE = (3, 1, 2), re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """sizes by source in order -> target; excess handed on until none is above."""
    total, target, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(WEIGH[i % 3] for i in open_)
        over = [i for i in open_ if left * WEIGH[i % 3] / weight >= 2 * sizes[i]]
        for i in open_:
            target[i] = left * WEIGH[i % 3] / weight
        if not over:
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
            open_.remove(i)
    return target


def check_mix(docs, rows):
    sizes = collections.Counter()
    for d in docs:
        sizes[d["source"]] += len(SPACE.findall(d["text"] or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    target = dict(zip(order, plain_targets([sizes[s] for s in order])))
    taken = collections.Counter()
    by_target = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[(r["source_size"], round(r["target"], 3))] += r["taken"]
        by_target[(r["source_size"], round(r["target"], 3))] = r["target"]
    for s in order:
        key = (sizes[s], round(target[s], 3))
        assert key in by_target
        same = sum((sizes[x], round(target[x], 3)) == key for x in order)
        assert abs(taken[key] - same * target[s]) <= same * 2 * mixing.BLOCK_WORDS


def test_mixing_query(spark):
    rows = QUERIES["op10_mixing"](spark, SF_SMALL).collect()
    docs = documents(spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in docs)
    check_mix(docs, rows)
    again = QUERIES["op10_mixing"](spark, SF_SMALL).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}


def test_mixing_messy(messy, empty):
    rows = mixing.Mix(messy).taken().collect()
    assert len(rows) == messy.count()
    check_mix(messy.select("source", "text").collect(), rows)
    assert {r["taken"] for r in rows if r["doc_id"] in (100, 101, 102)} == {0}
    assert mixing.Mix(empty).taken().count() == 0


def test_mixed_documents_hold_what_is_taken(messy, empty):
    mixed = mixing.mixed_documents(messy, chars_col="n_chars")
    assert mixed.columns == messy.columns
    got = collections.Counter()
    texts = collections.defaultdict(set)
    for d in messy.select("doc_id", "text").collect():
        texts[d["doc_id"]].add(d["text"])
    for r in mixed.select("doc_id", "text", "n_chars").collect():
        got[r["doc_id"]] += len(SPACE.findall(r["text"]))
        assert len(r["text"]) == r["n_chars"] and any(r["text"] in t for t in texts[r["doc_id"]] if t)
    want = collections.Counter()
    for r in mixing.Mix(messy).taken().collect():
        want[r["doc_id"]] += r["taken"]
    assert +got == +want
    assert mixing.mixed_documents(empty).count() == 0


def test_slots_fill_shards_and_no_block_is_drawn_thrice(spark):
    mix = mixing.Mix(documents(spark, SF_SMALL))
    slots = mix.slots.collect()
    assert sorted(r["shard"] * mixing.SLOTS_PER_SHARD + r["slot"] for r in slots) == list(range(len(slots)))
    times = collections.Counter((r["rank"], r["block"]) for r in slots)
    assert max(times.values()) <= 2
    for s in mix.sources.collect():
        blocks = [r["block"] for r in slots if r["rank"] == s["rank"]]
        assert len(blocks) == s["draws"] and all(0 <= b < s["blocks"] for b in blocks)


def test_shard_counts_are_the_replayed_multinomial_draw(spark, monkeypatch):
    """Each slot's draw is replayed with plain hashes; then only the surplus of a
    source changes hands, and all shards lose about the same."""
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 32)
    mix = mixing.Mix(documents(spark, SF_SMALL), block_words=16)
    planned = {s["rank"]: s["draws"] for s in mix.sources.collect()}
    total, owners = sum(planned.values()), [rank for rank in sorted(planned) for _ in range(planned[rank])]
    drawn = collections.Counter()
    for at in range(total):
        h = 42
        for part in (mixing.SEED, at // 32, at % 32):
            h = xxhash.xxh64_intdigest(struct.pack("<q", part), seed=h)
        signed = h - (1 << 64) if h >> 63 else h
        drawn[(at // 32, owners[signed % total])] += 1
    assert {(r["shard"], r["rank"]): r["n"] for r in mix.shard_counts.collect()} == drawn
    final = collections.Counter((r["shard"], r["rank"]) for r in mix.slots.collect())
    got = collections.Counter()
    for (_, rank), n in drawn.items():
        got[rank] += n
    surplus = sum(max(0, got[rank] - planned[rank]) for rank in planned)
    assert sum((final - drawn).values()) <= surplus and surplus <= 4 * total**0.5
    # Chi-square of the draws against the proportions, with its normal bound.
    cells = [(drawn[(shard, rank)], 32 * planned[rank] / total) for shard in range(total // 32) for rank in planned if planned[rank]]
    free = (total // 32) * (sum(map(bool, planned.values())) - 1)
    assert abs(sum((n - e) ** 2 / e for n, e in cells) - free) < 5 * (2 * free) ** 0.5


def test_slots_are_permuted_once(spark):
    """No filter repeats the permutations, and their walks are counted without jobs."""
    docs = documents(spark, SF_SMALL)
    for plan in (mixing.Mix(docs).taken(), mixing.mixed_documents(docs)):
        lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [line for line in lines if "Filter" in line and "lambda" in line]
        assert sum(line.count(f"[{feistel.round_keys(mixing.SEED)[0]},") for line in lines) == 2


@pytest.mark.parametrize("n", [1, 3, 12, 30, 1000, 4097, 99_991])
def test_longest_walk(spark, n):
    rows = [(n, key) for key in range(0, 200, 64)]
    assert feistel.longest_walk(rows, 10) == feistel.walk_steps(spark.createDataFrame(rows, "_n long, _key long"), 10)


def test_binary_search_skips_empty_sources(spark):
    firsts = [0, 5, 5, 8, 8]
    place = mixing._last_at_most(mixing._list(firsts), len(firsts), F.col("id"))
    assert [r[0] for r in spark.range(8).select(place).collect()] == [0] * 5 + [2] * 3


def test_equal_rows_meet_one_by_one(spark):
    """Many equal rows: as many come out as are drawn, and the join to the
    drawn runs is by their number too."""
    docs = spark.createDataFrame([(None, "one two three", "en", "src0", 13)] * 300 + [(1, "four five", "en", "src0", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mixed_documents(docs)
    got = collections.Counter()
    for r in mixed.select("doc_id", "text").collect():
        got[r["doc_id"]] += len(SPACE.findall(r["text"]))
    want = collections.Counter()
    for r in mixing.Mix(docs).taken().collect():
        want[r["doc_id"]] += r["taken"]
    assert +got == +want and want[None] > 0
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join" in line and "own_row#" in line for line in plan.splitlines())


def test_long_texts_are_split_once(spark):
    """A text's words are split in one place, before its runs become rows."""
    docs = spark.createDataFrame([(1, "a b c", "s", 5)], "doc_id long, text string, source string, n_chars long")
    plan = mixing.mixed_documents(docs, chars_col="n_chars")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert plan.count("split(") == 1 and "split(" not in above


def test_runs_of_a_long_text_are_its_words(spark):
    words = [f"w{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words), "a", 0), (2, "x y", "b", 0), (2, "x y", "b", 0)], "doc_id long, text string, source string, n_chars long")
    rows = mixing.mixed_documents(docs, chars_col="n_chars").collect()
    taken = {}
    for r in rows:
        assert len(r["text"]) == r["n_chars"]
        for w in r["text"].split(" "):
            taken[w] = taken.get(w, 0) + 1
    assert max(taken[w] for w in words if w in taken) <= 2 and taken["x"] == taken["y"]
    total = sum(r["taken"] for r in mixing.Mix(docs).taken().collect())
    assert sum(taken.values()) == total
